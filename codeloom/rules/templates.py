"""Default project templates. Contents are short starters; users add rows of their own."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    id: str
    name: str
    description: str
    category: str
    language: str
    tags: list[str]
    files: list[tuple[str, str, str]]  # path, language, content


# --- fixed values: ids, names, descriptions, categories, languages, tags, paths ----
TEMPLATES = [
    Template("python-web", "Python Web App", "Flask-based web application structure", "web", "python",
             ["flask", "web", "python", "starter"], [
                 ("app.py", "python", "from flask import Flask\n\napp = Flask(__name__)\n"),
                 ("requirements.txt", "text", "flask\n"),
                 ("config.py", "python", "DEBUG = True\n"),
                 ("templates/index.html", "html", "<!DOCTYPE html>\n<html><body></body></html>\n"),
                 ("static/style.css", "css", "body {\n  margin: 0;\n}\n"),
                 (".gitignore", "text", "__pycache__/\n.env\nvenv/\n"),
                 ("README.md", "markdown", "# Python Web App\n"),
             ]),
    Template("react-app", "React Application", "Basic React app with component structure", "web", "javascript",
             ["react", "frontend", "javascript", "starter"], [
                 ("src/index.js", "javascript", "import App from './App';\n"),
                 ("src/App.js", "javascript", "export default function App() { return null; }\n"),
                 ("src/App.css", "css", ".App {\n  padding: 20px;\n}\n"),
                 ("public/index.html", "html", "<!DOCTYPE html>\n<div id=\"root\"></div>\n"),
                 ("package.json", "json", "{\"name\": \"react-app\", \"version\": \"1.0.0\"}\n"),
             ]),
    Template("node-api", "Node.js REST API", "Express-based REST API server", "backend", "javascript",
             ["express", "api", "node", "backend", "starter"], [
                 ("index.js", "javascript", "const app = require('express')();\napp.listen(3000);\n"),
                 ("package.json", "json", "{\"name\": \"node-api\", \"version\": \"1.0.0\"}\n"),
                 (".env", "text", "PORT=3000\n"),
                 (".gitignore", "text", "node_modules/\n.env\n"),
                 ("README.md", "markdown", "# Node.js REST API\n"),
             ]),
    Template("python-data", "Python Data Science", "Data analysis project with Jupyter notebooks", "data", "python",
             ["data", "pandas", "python", "jupyter", "starter"], [
                 ("main.py", "python", "import pandas as pd\n"),
                 ("requirements.txt", "text", "pandas\nnumpy\n"),
                 ("notebooks/analysis.ipynb", "json", "{\"cells\": []}\n"),
                 ("data/.gitkeep", "text", ""),
                 ("README.md", "markdown", "# Data Science Project\n"),
             ]),
    Template("chrome-extension", "Chrome Extension", "Basic Chrome extension structure", "extension", "javascript",
             ["chrome", "extension", "javascript", "starter"], [
                 ("manifest.json", "json", "{\"manifest_version\": 3, \"name\": \"My Extension\"}\n"),
                 ("popup.html", "html", "<!DOCTYPE html>\n<h1>My Extension</h1>\n"),
                 ("popup.js", "javascript", "console.log('loaded');\n"),
                 ("background.js", "javascript", "console.log('installed');\n"),
             ]),
    Template("empty-project", "Empty Project", "Blank project structure with README", "general", "text",
             ["empty", "blank", "starter"], [
                 ("README.md", "markdown", "# Project\n"),
                 (".gitignore", "text", ""),
             ]),
]
