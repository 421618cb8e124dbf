"""Fixed values for file naming: patterns, content fingerprints, filler openings."""

# --- fixed values: patterns ---------------------------------------------------
FILE_LIKE = r"([a-zA-Z0-9_][a-zA-Z0-9_.\-/\\]*\.[a-zA-Z0-9]{1,6})"
CREATE_PHRASE = (r"(?i)(?:create|new|save|write|make)\s+(?:the\s+)?(?:file\s+)?"
                 r"([a-zA-Z0-9_/\\.\-]+\.[a-zA-Z0-9]{1,6})")
COMMENT_NAME = (r"(?i)(?:^|\n)(?://|#|/\*|--)[ \t\r]*(?:filename|file|name):[ \t\r]*"
                r"([a-zA-Z0-9_/\\.\-]+\.[a-zA-Z0-9]{1,6})")
HEADING_BLOCK = r"(?i)^(?:block|step|section|part)\s+([0-9]+)\s*[:\-]\s*([^\n]+)$"
HEADING_MARKDOWN = r"^#{1,4}\s+(?:([0-9]+)[.)]\s+)?([^\n]+)$"
HEADING_NUMBERED = r"^([0-9]+)[.):]\s+([^\n]+)$"
FILLER = r"(?i)^(?:here|sure|certainly|yes|below|the code|this code|example|updated|following|let's)"
IGNORE_LINE = r"^[#*!]|node_modules|\.env|\.DS_Store|dist/|build/"
TREE_CHARS = "├└│─┬┼"
TREE_LINE = "[├└│─]"

# --- fixed values: JSON kinds, (all patterns must match, file name) -------------
JSON_KINDS = [
    ([r'"manifest_version"\s*:'], "manifest.json"),
    ([r'"compilerOptions"\s*:'], "tsconfig.json"),
    ([r'"eslintConfig"\s*:|"eslintIgnore"\s*:'], ".eslintrc.json"),
    ([r'"prettier"\s*:'], ".prettierrc.json"),
    ([r'"jest"\s*:', r'"testMatch"\s*:|"testEnvironment"\s*:'], "jest.config.json"),
    ([r'"scripts"\s*:', r'"dependencies"\s*:|"devDependencies"\s*:|"name"\s*:'], "package.json"),
    ([r'"dependencies"\s*:', r'"version"\s*:', r'!"scripts"'], "package-lock.json"),
    ([r'"babelrc"\s*:|"presets"\s*:\s*\['], ".babelrc"),
    ([r'"launch"\s*:|"configurations"\s*:\s*\['], "launch.json"),
    ([r'"recommendations"\s*:\s*\['], "extensions.json"),
    ([r'"editor\.|"workbench\.'], "settings.json"),
]

# --- fixed values: fingerprints per language, (language, patterns, file name) ---
# A pattern with a leading "!" must not match. Order matters: first match wins.
FINGERPRINTS_BEFORE_IGNORE = [
    ("yaml", [r"(?:^|\n)name:\s*\S+", r"(?:^|\n)on:"], "workflow.yml"),
    ("yaml", [r"(?:^|\n)services:"], "docker-compose.yml"),
    ("yaml", [r"(?:^|\n)version:", r"(?:^|\n)dependencies:"], "pubspec.yaml"),
    (None, [r"(?:^|\n)FROM\s+\S+"], "Dockerfile"),
]
FINGERPRINTS_AFTER_IGNORE = [
    ("markdown", [r"(?i)(?:^|\n)#\s+(?:README|Getting Started|Installation|Overview|Introduction)"], "README.md"),
    ("markdown", [r"(?i)(?:^|\n)#\s+CHANGELOG|(?:^|\n)##\s+[0-9]+\.[0-9]+"], "CHANGELOG.md"),
    ("markdown", [r"(?i)(?:^|\n)#\s+(?:Contributing|How to Contribute)"], "CONTRIBUTING.md"),
    ("markdown", [r"(?i)(?:^|\n)#\s+(?:License|MIT License|Apache)"], "LICENSE.md"),
    ("markdown", [], "README.md"),
    ("bash", [r"(?:^|\n)#!/bin/(?:ba)?sh"], "setup.sh"),
    ("css", [r":root\s*\{|(?:^|\n)\*\s*\{"], "index.css"),
    ("scss", [r"(?:^|\n)\$[a-z]+-[a-z]+:"], "_variables.scss"),
    ("html", [r"(?i)<!DOCTYPE html>", r'(?i)<title>\s*index|<main|<app-root|id="root"|id="app"'], "index.html"),
    ("python", [r"""(?:^|\n)if __name__\s*==\s*['"]__main__['"](?:\n|$)"""], "main.py"),
    ("python", [r"(?:^|\n)class[^\n]*\([^\n]*TestCase\)|(?:^|\n)def test_"], "test_suite.py"),
    ("python", [r"(?:^|\n)from setuptools import|(?:^|\n)setup\("], "setup.py"),
    ("sql", [r"(?i)CREATE TABLE"], "schema.sql"),
    ("sql", [r"(?i)INSERT INTO"], "seed.sql"),
]

# --- fixed values: headings that never name a project ---------------------------
GENERIC_HEADINGS = ["dashboard", "chat", "project", "home", "overview", "untitled", "new chat"]

# --- fixed values: host substring -> platform label, in order --------------------
PLATFORMS = [
    ("outlier", "Outlier"), ("chatgpt", "ChatGPT"), ("openai", "ChatGPT"), ("claude", "Claude"),
    ("anthropic", "Claude"), ("github", "GitHub"), ("stackoverflow", "StackOverflow"), ("google", "Gemini"),
    ("gemini", "Gemini"),
]
# --- fixed values: page-title suffixes that are dropped --------------------------
TITLE_SUFFIXES = [r"(?i) - ChatGPT", r"(?i) - Claude", r"(?i) - Gemini", r"(?i) \| Outlier"]
