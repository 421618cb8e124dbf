"""Fixed values about languages: aliases, file names, extensions, indicators, folders."""

# --- fixed values: alias -> canonical language ---------------------------------
ALIASES = {
    "js": "javascript", "ts": "typescript", "py": "python", "rb": "ruby", "rs": "rust", "cs": "csharp",
    "c++": "cpp", "c#": "csharp", "sh": "bash", "shell": "bash", "yml": "yaml", "md": "markdown",
    "html5": "html", "css3": "css", "es6": "javascript", "node": "javascript", "react": "javascript",
    "vuejs": "vue", "tsx": "typescript", "jsx": "javascript",
}

# --- fixed values: aliases used for the language attribute of an HTML block -----
BLOCK_ALIASES = {
    "js": "javascript", "py": "python", "ts": "typescript", "rb": "ruby", "rs": "rust", "cs": "csharp",
    "c++": "cpp", "c#": "csharp", "sh": "bash", "shell": "bash", "yml": "yaml", "md": "markdown",
    "html5": "html", "css3": "css", "node": "javascript", "react": "javascript", "golang": "go",
    "jsx": "javascript", "tsx": "typescript",
}

# --- fixed values: file extension -> language -----------------------------------
EXTENSION_LANGUAGE = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp",
    ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift",
    ".kt": "kotlin", ".kts": "kotlin", ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss",
    ".sass": "sass", ".json": "json", ".yml": "yaml", ".yaml": "yaml", ".xml": "xml", ".md": "markdown",
    ".markdown": "markdown", ".sql": "sql", ".sh": "bash", ".bash": "bash", ".ps1": "powershell", ".r": "r",
    ".m": "matlab", ".scala": "scala", ".pl": "perl", ".lua": "lua", ".dart": "dart", ".vue": "vue",
    ".svelte": "svelte", ".graphql": "graphql", ".gql": "graphql", ".proto": "proto", ".toml": "toml",
    ".ini": "ini",
}

# --- fixed values: whole file name -> language ----------------------------------
SPECIAL_FILES = {
    "dockerfile": "dockerfile", "makefile": "makefile", ".gitignore": "text", ".env": "text",
    "license": "text", "readme": "markdown",
}

# --- fixed values: language -> extension of a generated name ---------------------
NAME_EXTENSION = {
    "python": ".py", "javascript": ".js", "typescript": ".ts", "java": ".java", "cpp": ".cpp", "c": ".c",
    "csharp": ".cs", "go": ".go", "rust": ".rs", "ruby": ".rb", "php": ".php", "swift": ".swift",
    "kotlin": ".kt", "html": ".html", "css": ".css", "scss": ".scss", "json": ".json", "yaml": ".yml",
    "xml": ".xml", "markdown": ".md", "sql": ".sql", "bash": ".sh", "powershell": ".ps1",
}

# --- fixed values: languages whose generated name is a whole file name -----------
WHOLE_NAME = {"dockerfile": "Dockerfile", "makefile": "Makefile"}

# --- fixed values: language -> extension of a refined name -----------------------
REFINED_EXTENSION = {
    "javascript": ".js", "typescript": ".ts", "python": ".py", "java": ".java", "kotlin": ".kt", "go": ".go",
    "rust": ".rs", "ruby": ".rb", "php": ".php", "swift": ".swift", "csharp": ".cs", "cpp": ".cpp", "c": ".c",
    "html": ".html", "css": ".css", "scss": ".scss", "less": ".less", "sql": ".sql", "bash": ".sh",
    "shell": ".sh", "json": ".json", "yaml": ".yml", "xml": ".xml", "markdown": ".md", "vue": ".vue",
    "svelte": ".svelte",
}

# --- fixed values: language -> extension, the full listing -----------------------
LANGUAGE_EXTENSION = {
    "python": ".py", "javascript": ".js", "typescript": ".ts", "tsx": ".tsx", "jsx": ".jsx", "java": ".java",
    "cpp": ".cpp", "c++": ".cpp", "c": ".c", "c#": ".cs", "csharp": ".cs", "go": ".go", "golang": ".go",
    "rust": ".rs", "ruby": ".rb", "php": ".php", "swift": ".swift", "kotlin": ".kt", "html": ".html",
    "css": ".css", "scss": ".scss", "sass": ".sass", "json": ".json", "yaml": ".yml", "yml": ".yml",
    "xml": ".xml", "markdown": ".md", "md": ".md", "sql": ".sql", "bash": ".sh", "shell": ".sh", "sh": ".sh",
    "powershell": ".ps1", "ps1": ".ps1", "dockerfile": "Dockerfile", "makefile": "Makefile", "r": ".r",
    "matlab": ".m", "scala": ".scala", "perl": ".pl", "lua": ".lua", "dart": ".dart", "vue": ".vue",
    "svelte": ".svelte", "graphql": ".graphql", "proto": ".proto", "toml": ".toml", "ini": ".ini",
    "txt": ".txt", "text": ".txt",
}

# --- fixed values: language -> folder --------------------------------------------
LANGUAGE_FOLDER = {
    "python": "src", "javascript": "src", "typescript": "src", "html": "public", "css": "public/css",
    "scss": "src/styles", "json": "config", "yaml": "config", "sql": "database", "bash": "scripts",
    "powershell": "scripts",
}

# --- fixed values: languages accepted by the quality gate ------------------------
VALID_LANGUAGES = [
    "python", "javascript", "typescript", "java", "cpp", "c", "csharp", "go", "rust", "ruby", "php", "swift",
    "kotlin", "html", "css", "scss", "json", "yaml", "xml", "markdown", "sql", "bash", "powershell",
    "dockerfile", "makefile", "r", "matlab", "scala", "perl", "lua", "dart", "vue", "svelte", "graphql", "text",
]

# --- fixed values: content indicators, (language, weight, substrings), in tie order -
INDICATORS = [
    ("python", 2, ["import ", "from ", "def ", "class ", "print(", "if __name__", "async def", "await ",
                   "self.", "lambda "]),
    ("javascript", 2, ["const ", "let ", "var ", "function ", "=>", "require(", "module.exports",
                       "console.log", "document.", "window."]),
    ("typescript", 3, ["interface ", "type ", "as ", ": string", ": number", "enum ", "namespace ", "public ",
                       "private "]),
    ("java", 2, ["public class ", "private ", "public static void main", "import java.", "System.out.",
                 "@Override"]),
    ("cpp", 2, ["#include <", "std::", "cout <<", "using namespace", "int main(", "vector<"]),
    ("c", 2, ["#include <", "printf(", "int main(", "scanf(", "malloc(", "free("]),
    ("csharp", 2, ["using System;", "namespace ", "public class ", "Console.WriteLine", "[HttpGet]",
                   "async Task"]),
    ("go", 2, ["package main", "func main(", "import (", "fmt.Println", "go ", "chan ", "defer "]),
    ("rust", 2, ["fn main()", "let mut ", "println!", "use std::", "impl ", "pub fn", "match "]),
    ("ruby", 2, ["def ", "end", "puts ", "require '", "class ", "module ", "attr_accessor"]),
    ("php", 2, ["<?php", "echo ", "$_GET", "$_POST", "function ", "$this->", "namespace "]),
    ("swift", 2, ["import ", "func ", "let ", "var ", "class ", "struct ", "override "]),
    ("kotlin", 2, ["fun main(", "val ", "var ", "class ", "import ", "data class ", "companion object"]),
    ("html", 1, ["<!DOCTYPE", "<html", "<head", "<body", "<div", "<span", "<p>", "<h1"]),
    ("css", 1, ["{", "}", ":", ";", "margin:", "padding:", "color:", "display:", "background:", "font-"]),
    ("json", 1, ['"', "{", "}", ":", ",", "[", "]"]),
    ("yaml", 1, ["  ", ":", "-", "|", ">"]),
    ("sql", 2, ["SELECT ", "FROM ", "WHERE ", "INSERT ", "CREATE TABLE", "ALTER TABLE", "DELETE FROM",
                "UPDATE "]),
    ("bash", 2, ["#!/bin/bash", "#!/bin/sh", "echo ", "export ", "cd ", "chmod ", "sudo "]),
    ("dockerfile", 3, ["FROM ", "RUN ", "COPY ", "CMD ", "ENTRYPOINT", "WORKDIR ", "EXPOSE "]),
    ("makefile", 3, [".PHONY:", "all:", "clean:", "install:", "\t"]),
    ("xml", 1, ["<?xml", "<", ">", "</"]),
    ("markdown", 1, ["#", "**", "*", "```", "[", "![", "> "]),
]

# --- fixed values: unit-weight indicators of the corpus-level scorer -------------
UNIT_INDICATORS = [
    ("python", 1, ["import ", "from ", "def ", "class ", "print(", "if __name__", "async def", "await "]),
    ("javascript", 1, ["const ", "let ", "var ", "function ", "=>", "require(", "module.exports",
                       "console.log"]),
    ("typescript", 1, ["interface ", "type ", "as ", ": string", ": number", "enum ", "namespace "]),
    ("java", 1, ["public class ", "private ", "public static void main", "import java.", "System.out."]),
    ("cpp", 1, ["#include <", "std::", "cout <<", "using namespace", "int main("]),
    ("c", 1, ["#include <", "printf(", "int main(", "scanf("]),
    ("csharp", 1, ["using System;", "namespace ", "public class ", "Console.WriteLine"]),
    ("go", 1, ["package main", "func main(", "import (", "fmt.Println"]),
    ("rust", 1, ["fn main()", "let mut ", "println!", "use std::"]),
    ("ruby", 1, ["def ", "end", "puts ", "require '", "class "]),
    ("php", 1, ["<?php", "echo ", "$_GET", "$_POST", "function "]),
    ("swift", 1, ["import ", "func ", "let ", "var ", "class "]),
    ("kotlin", 1, ["fun main(", "val ", "var ", "class ", "import "]),
    ("html", 1, ["<!DOCTYPE", "<html", "<head", "<body", "<div"]),
    ("css", 1, ["{", "}", ":", ";", "margin:", "padding:", "color:", "display:"]),
    ("json", 1, ["{", "}", ":", ",", '"']),
    ("yaml", 1, ["  ", ":", "-", "|", ">"]),
    ("sql", 1, ["SELECT ", "FROM ", "WHERE ", "INSERT ", "CREATE TABLE", "ALTER TABLE"]),
    ("bash", 1, ["#!/bin/bash", "#!/bin/sh", "echo ", "export ", "cd "]),
    ("dockerfile", 1, ["FROM ", "RUN ", "COPY ", "CMD ", "ENTRYPOINT", "WORKDIR "]),
    ("makefile", 1, [".PHONY:", "all:", "clean:", "install:", "\t"]),
]

# --- fixed values: indicators of the block-level scorer (threshold 2) -------------
BLOCK_INDICATORS = [
    ("python", 1, ["import ", "from ", "def ", "class ", "print(", "if __name__", "self.", "elif ", "lambda "]),
    ("javascript", 1, ["const ", "let ", "var ", "function ", "=>", "require(", "module.exports",
                       "console.log"]),
    ("typescript", 1, ["interface ", "type ", "as ", ": string", ": number", "enum ", "namespace "]),
    ("html", 1, ["<!DOCTYPE", "<html", "<head", "<body", "<div", "<span", "<p>"]),
    ("css", 1, ["{", "}", ":", ";", "margin:", "padding:", "color:", "display:"]),
    ("json", 1, ["{", "}", ":", ",", '"']),
    ("yaml", 1, ["  ", ":", "-", "|", ">"]),
    ("sql", 1, ["SELECT ", "FROM ", "WHERE ", "INSERT ", "CREATE TABLE"]),
    ("bash", 1, ["#!/bin/bash", "#!/bin/sh", "echo ", "export ", "cd "]),
    ("dockerfile", 1, ["FROM ", "RUN ", "COPY ", "CMD ", "ENTRYPOINT"]),
    ("java", 1, ["public class ", "private ", "public static void main", "import java."]),
    ("go", 1, ["package main", "func main(", "import (", "fmt.Println"]),
    ("rust", 1, ["fn main()", "let mut ", "println!", "use std::"]),
    ("ruby", 1, ["def ", "end", "puts ", "require '", "class "]),
    ("php", 1, ["<?php", "echo ", "$_GET", "$_POST"]),
]

# --- fixed values: indicators behind the confidence of a declared language ---------
CONFIDENCE_INDICATORS = {
    "python": ["import ", "from ", "def ", "class "],
    "javascript": ["const ", "let ", "function ", "=>"],
    "typescript": ["interface ", "type ", ": string", ": number"],
    "html": ["<", ">", "</"],
    "css": ["{", "}", ":", ";"],
    "json": ['"', "{", "}", ","],
}

# --- fixed values: language words looked for in a block's header label -------------
HEADER_WORDS = [
    "javascript", "python", "java", "typescript", "html", "css", "json", "yaml", "xml", "sql", "bash", "shell",
    "ruby", "php", "go", "golang", "rust", "c++", "c#", "csharp", "swift", "kotlin", "dart", "scala", "lua",
    "perl", "haskell", "elixir", "vue", "svelte", "dockerfile", "makefile", "toml", "ini", "markdown", "text",
    "powershell", "batch", "matlab", "julia", "zig", "nim", "solidity", "terraform", "graphql", "protobuf",
    "csv", "log", "diff", "gitignore",
]
