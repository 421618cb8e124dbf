"""Fixed values of generated files: ignore lists and set-up notes by language."""

# --- fixed values: ignore patterns by language ------------------------------------------
_NODE = ["# Node.js", "node_modules/", "dist/", "build/", ".next/", ".nuxt/", ".cache/", "coverage/", "*.log", "npm-debug.log*",
         ".env", ".env.local", ".env.*.local", ".DS_Store"]
IGNORE_BY_LANGUAGE = {
    "python": ["# Python", "__pycache__/", "*.py[cod]", "*$py.class", "*.so", ".Python", "env/", "venv/", ".venv/", "*.egg-info/",
               "dist/", "build/", ".eggs/", "*.egg", ".env", ".env.local", "*.log", ".mypy_cache/", ".pytest_cache/", ".coverage",
               "htmlcov/"],
    "javascript": _NODE,
    "typescript": _NODE,
    "java": ["# Java", "*.class", "*.jar", "*.war", "*.ear", "target/", ".idea/", "*.iml", ".gradle/", "build/", ".settings/",
             ".project", ".classpath"],
    "go": ["# Go", "bin/", "pkg/", "*.exe", "*.test", "*.out", "vendor/", ".env"],
    "rust": ["# Rust", "target/", "Cargo.lock", "**/*.rs.bk"],
    "ruby": ["# Ruby", "*.gem", ".bundle/", "vendor/bundle", "log/", "tmp/"],
    "php": ["# PHP", "vendor/", "composer.lock", ".env"],
    "swift": ["# Swift", ".DS_Store", "*.xcodeproj/", "*.xcworkspace/", "build/"],
    "csharp": ["# C#", "bin/", "obj/", "*.exe", "*.dll", "*.pdb", "*.suo", "*.user"],
}
IGNORE_GENERIC = ["# Generic", ".DS_Store", "Thumbs.db", "*.log", "*.tmp", "*.temp", ".env", ".env.local", ".vscode/", ".idea/",
                  "*.swp", "*~"]
IGNORE_TAIL = ["# OS", ".DS_Store", "Thumbs.db", "", "# IDE", ".vscode/", ".idea/", "*.swp", "*.swo", "*~", "", "# Environment",
               ".env", ".env.local", ".env.*.local", "", "# Logs", "*.log", "logs/"]
IGNORE_HEAD = ["# Combined ignore list for the detected languages", ""]

# --- fixed values: set-up notes by language (title, commands) ------------------------------
_NODE_SETUP = ("Node.js Setup", ["npm install", "npm start"])
SETUP = {
    "python": ("Python Setup", ["python -m venv venv", "source venv/bin/activate  # Linux/Mac", "venv\\Scripts\\activate     # Windows",
                                "pip install -r requirements.txt", "python app.py"]),
    "javascript": _NODE_SETUP,
    "typescript": _NODE_SETUP,
    "java": ("Java Setup", ["# Using Maven", "mvn clean install", "mvn spring-boot:run", "", "# Using Gradle", "gradle build", "gradle bootRun"]),
    "go": ("Go Setup", ["go mod download", "go run main.go"]),
    "rust": ("Rust Setup", ["cargo build", "cargo run"]),
    "ruby": ("Ruby Setup", ["bundle install", "ruby app.rb"]),
    "php": ("PHP Setup", ["composer install", "php -S localhost:8000"]),
}
