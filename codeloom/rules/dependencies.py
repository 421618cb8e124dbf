"""Fixed values about dependencies: standard libraries, main-file candidates, presence flags."""

# --- fixed values: Python standard library packages ------------------------------------
PYTHON_STDLIB = [
    "os", "sys", "json", "re", "math", "datetime", "collections", "itertools", "functools", "typing", "pathlib", "io",
    "copy", "time", "random", "string", "textwrap", "logging", "unittest", "argparse", "subprocess", "threading",
    "multiprocessing", "http", "urllib", "email", "html", "xml", "csv", "hashlib", "hmac", "secrets", "pickle", "shelve",
    "sqlite3", "struct", "codecs", "unicodedata", "difflib", "enum", "graphlib", "contextlib", "abc", "atexit",
    "traceback", "warnings", "dataclasses", "types", "inspect", "dis", "gc", "pprint", "reprlib", "wrapcache", "tempfile",
    "glob", "shutil", "fnmatch", "stat", "fileinput", "filecmp", "zipfile", "tarfile", "gzip", "bz2", "lzma", "zlib",
    "platform", "errno", "ctypes", "signal", "mmap", "asyncio", "concurrent", "queue", "sched", "select", "socket", "ssl",
    "ftplib", "poplib", "imaplib", "smtplib", "uuid", "decimal", "fractions", "statistics", "array", "bisect", "heapq",
    "operator",
]
# --- fixed values: first path segments of the Go standard library ------------------------
GO_STDLIB = [
    "fmt", "os", "io", "net", "http", "json", "strings", "strconv", "errors", "log", "time", "sync", "context", "bufio",
    "bytes", "path", "regexp", "sort", "math", "reflect", "runtime", "testing", "flag", "text", "encoding", "crypto",
    "database", "html", "mime", "archive", "compress", "container", "debug", "embed", "expvar", "go", "hash", "image",
    "index", "internal", "maps", "plugin", "slices", "syscall", "trace", "unsafe",
]
# --- fixed values: main-file candidates, in order -----------------------------------------
MAIN_FILES = ["index.js", "index.ts", "main.js", "main.ts", "app.js", "app.ts", "server.js", "server.ts"]
# --- fixed values: marks of Java libraries ---------------------------------------------------
SPRING_MARKS = ["org.springframework", "@SpringBootApplication", "@RestController"]
JUNIT_MARKS = ["org.junit", "@Test"]
