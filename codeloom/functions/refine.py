"""Refined file names from content signals.

Signals are boolean columns; names are proposed in a fixed order in which later proposals
override earlier ones. Confidence is the largest of the proposals made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from codeloom.functions.text import extract, lookup, once
from codeloom.rules import languages as L

# --- fixed values: confidence of each signal ----------------------------------------------
CONFIDENCE = {"none": 0.3, "pattern": 0.8, "export": 0.6, "main": 0.5, "test": 0.7, "config": 0.85, "component": 0.75, "route": 0.7,
              "model": 0.7, "middleware": 0.65, "utility": 0.55, "hook": 0.7, "service": 0.65}
# --- fixed values: wording of each reason ----------------------------------------------------
REASONS = {"main": "Main function detected", "test": "Test file detected", "config": "Config file detected", "component": "Component detected",
           "route": "Route handler detected", "model": "Model/schema detected", "middleware": "Middleware detected",
           "utility": "Utility module detected", "hook": "Custom hook detected", "service": "Service detected"}
# --- fixed values: marks of tests --------------------------------------------------------------
TEST_MARKS = ["describe(", "it(", "test(", "unittest.", "@pytest", "def test_"]
# --- fixed values: JSON configuration kinds, first match wins ---------------------------------------
JSON_CONFIG = [
    (r'"manifest_version"\s*:', "manifest.json"), (r'"compilerOptions"\s*:', "tsconfig.json"),
    (r'"scripts"\s*:.*"dependencies"\s*:', "package.json"), (r'"name"\s*:.*"version"\s*:.*"scripts"\s*:', "package.json"),
    (r'"dependencies"\s*:', "package-lock.json"), (r'"workspaces"\s*:', "pnpm-workspace.yaml"), (r'"babel"\s*:|"presets"\s*:', ".babelrc"),
    (r'"eslintConfig"\s*:', ".eslintrc.json"), (r'"prettier"\s*:', ".prettierrc"), (r'"jest"\s*:', "jest.config.js"),
    (r'"launch"\s*:.*"configurations"\s*:', "launch.json"), (r'"recommendations"\s*:', "extensions.json"), (r'"editor\.', "settings.json"),
    (r'"tailwindConfig"\s*:', "tailwind.config.js"), (r'"vite"\s*:', "vite.config.js"), (r'"webpack"\s*:', "webpack.config.js"),
]
# --- fixed values: content patterns by language: (languages, patterns that must all match, name, reason) ----
PATTERNS = [
    (["markdown"], [r"(?i)(?:^|\n)#\s+(?:README|Getting Started|Overview)"], "README.md", "README detected"),
    (["markdown"], [r"(?i)(?:^|\n)#\s+CHANGELOG"], "CHANGELOG.md", "Changelog detected"),
    (["markdown"], [r"(?i)(?:^|\n)#\s+Contributing"], "CONTRIBUTING.md", "Contributing guide detected"),
    (["dockerfile"], [], "Dockerfile", "Dockerfile detected"),
    (None, [r"(?:^|\n)FROM\s+\S+"], "Dockerfile", "Dockerfile detected"),
    (["css", "scss", "less"], [r"(?i)\.btn|button\s*\{"], "buttons.css", "Button styles detected"),
    (["css", "scss", "less"], [r":root\s*\{|--[\w-]+\s*:"], "variables.css", "CSS variables/root detected"),
    (["css", "scss", "less"], [r"@media", r"\.container|\.wrapper"], "layout.css", "Responsive layout detected"),
    (["sql"], [r"(?i)CREATE TABLE"], "schema.sql", "Table creation detected"),
    (["sql"], [r"(?i)INSERT INTO"], "seed.sql", "Data insertion detected"),
    (["sql"], [r"(?i)SELECT [^\n]* FROM [^\n]* WHERE"], "query.sql", "SELECT query detected"),
    (["html"], [r"(?i)<form"], "form.html", "HTML form detected"),
    (["html"], [r"(?i)<table"], "table.html", "HTML table detected"),
    (["bash", "shell"], [r"^#!/bin/bash", r"(?i)install|setup|init"], "setup.sh", "Setup/install script detected"),
    (["bash", "shell"], [r"^#!/bin/bash", r"(?i)deploy|release|publish"], "deploy.sh", "Deploy script detected"),
]
WEB = ["javascript", "typescript", "vue", "svelte"]
JVM = ["java", "kotlin"]


def _all(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [c.rlike(p) for p in patterns], F.lit(True))


def signals(content: Column, language: Column) -> dict[str, Column]:
    """Boolean signals and the names they carry."""
    c, lang = content, language
    web, jvm, py = lang.isin(*WEB), lang.isin(*JVM), lang == "python"
    class_name = extract(c, r"class\s+(\w+)")
    service_class = extract(c, r"class\s+(\w*Service)")
    py_class = py & c.rlike(r"class\s+\w+\s*\(")
    py_model = py_class & (class_name.endswith("Model") | c.rlike(r"fields\s*=|Meta:|objects\s*="))
    py_service = py_class & ~py_model & class_name.endswith("Service")
    py_middleware = py_class & ~py_model & ~py_service & class_name.endswith("Middleware")
    test = (reduce(lambda a, b: a | b, [c.contains(m) for m in TEST_MARKS]) | (jvm & c.contains("@Test"))
            | ((lang == "go") & c.rlike(r"func\s+Test\w+")) | ((lang == "rust") & c.rlike(r"fn\s+test_\w+|#\[test\]")))
    config = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, name in JSON_CONFIG:
        config = config.when((lang == "json") & c.rlike(pattern), F.lit(name))
    config = config.when((lang == "yaml") & c.rlike(r"""(?:^|\n)services:|(?:^|\n)version:\s*['"]?3"""), F.lit("docker-compose.yml")).when(
        (lang == "yaml") & c.rlike(r"(?:^|\n)name:\s*\S+") & c.rlike(r"(?:^|\n)on:"), F.lit("workflow.yml"))
    pattern = F.when(F.lit(False), F.lit(None).cast("string"))
    reason = F.when(F.lit(False), F.lit(None).cast("string"))
    for languages, patterns, name, why in PATTERNS:
        hit = _all(c, patterns) if languages is None else lang.isin(*languages) & _all(c, patterns)
        pattern, reason = pattern.when(hit, F.lit(name)), reason.when(hit, F.lit(why))
    s = {
        "main": (lang.isin("python", "javascript", "typescript") & c.rlike(r"(?:def |const |let |var |function )\s*main\s*\("))
        | (py & c.rlike(r"""(?:^|\n)if __name__\s*==\s*['"]__main__['"]""")) | ((lang == "go") & c.rlike(r"func\s+main\s*\(")),
        "test": test,
        "component": web & (c.rlike(r"(?i)<template>") | c.rlike(r"return\s*\(\s*<") | c.rlike(r"h\(")),
        "hook": web & c.rlike(r"use[A-Z]\w+\s*=\s*(?:\(|async\s*\()") & c.rlike(r"return\s*\["),
        "route": (web & (c.rlike(r"export\s+(?:default\s+)?(?:function|const|class)\s+\w+[^\n]*(?:Request|Response|NextApi|Handler)")
                         | c.rlike(r"app\.(?:get|post|put|delete|patch)\s*\(")
                         | c.rlike(r"export\s+(?:default\s+)?function\s+(?:GET|POST|PUT|DELETE|PATCH)")))
        | (jvm & c.rlike(r"@RestController|@Controller|@RequestMapping")),
        "middleware": (web & (c.rlike(r"export\s+(?:default\s+)?function\s+\w*[Mm]iddleware") | c.rlike(r"app\.use\("))) | F.coalesce(py_middleware, F.lit(False)),
        "service": (web & (c.rlike(r"class\s+\w+\s+extends\s+(?:Service|BaseService)") | c.rlike(r"export\s+(?:default\s+)?class\s+\w*Service")))
        | F.coalesce(py_service, F.lit(False)) | (jvm & c.rlike(r"@Service|@Component"))
        | ((lang == "go") & c.rlike(r"func\s+\w+\s*\(\s*\*?\w+\s+\w+\)\s+\w+")),
        "model": F.coalesce(py_model, F.lit(False)) | (jvm & (c.rlike(r"class\s+\w+\s+extends\s+(?:Model|Entity|BaseEntity)") | c.rlike(r"@Entity|@Table|@Column")))
        | ((lang == "rust") & c.rlike(r"struct\s+\w+") & c.rlike(r"#\[derive")),
        "config_name": config, "pattern": pattern, "pattern_reason": reason,
        "component_name": F.coalesce(extract(c, r"export\s+(?:default\s+)?(?:function|class|const)\s+([A-Z]\w+)"),
                                     extract(c, r"(?:function|const)\s+([A-Z]\w+)\s*[(=]"), F.lit("Component")),
        "hook_name": F.coalesce(extract(c, r"(?:function|const)\s+(use[A-Z]\w*)"), F.lit("useCustom")),
        "route_path": F.when(web, extract(c, r"(/[\w\-/]+)")),
        "model_name": F.coalesce(F.when(lang == "rust", extract(c, r"struct\s+(\w+)")).otherwise(class_name), F.lit("Model")),
        "service_name": F.coalesce(F.when(web, service_class).when(lang != "go", class_name), F.lit("Service")),
        "export": F.when(web, extract(c, r"export\s+(?:default\s+)?(?:function|const|class|let|var)\s+(\w+)"))
        .when(py, extract(c, r"(?:^|\n)(?:def|class)\s+(\w+)")),
    }
    s["config"] = s["config_name"].isNotNull()
    first_lines = F.substring_index(c, "\n", 10)
    s["utility"] = (py & first_lines.rlike(r"from\s+[\w.]+\s+import\s+\w+|import\s+\w+") & ~s["model"] & ~s["service"] & ~s["test"])
    plain = reduce(lambda a, b: a & b, [~s[k] for k in ("component", "model", "service", "route", "middleware", "hook", "utility", "test", "config")])
    s["plain_export"] = F.coalesce(s["pattern"].isNull() & plain & s["export"].isNotNull(), F.lit(False))
    return s


SIGNALS = ["main", "test", "config", "component", "route", "model", "middleware", "utility", "hook", "service"]
CARRIED = ["config_name", "pattern", "pattern_reason", "component_name", "hook_name", "route_path", "model_name", "service_name", "export", "plain_export"]


def refined_extension(language: Column) -> Column:
    return F.coalesce(lookup(L.REFINED_EXTENSION, F.lower(language)), F.lit(".txt"))


def _lower_first(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))


def _test_name(name: Column, language: Column, ext: Column) -> Column:
    base = F.regexp_replace(name, r"\.\w+$", "")
    return (F.when(language == "python", F.concat(F.lit("test_"), base, F.lit(".py")))
            .when(language.isin(*JVM), F.concat(base, F.lit("Test"), ext)).when(language == "go", F.concat(base, F.lit("_test.go")))
            .when(language == "rust", F.concat(F.lit("test_"), base, F.lit(".rs"))).otherwise(F.concat(base, F.lit(".test"), ext)))


def propose(sig: Column, language: Column, file_name: Column) -> tuple[Column, Column, Column]:
    """Refined name, confidence and reasons from a struct of signals."""
    ext = refined_extension(language)
    exported = F.concat(_lower_first(sig["export"]), ext)
    pattern = F.coalesce(sig["pattern"], F.when(sig["plain_export"], exported))
    why = F.coalesce(sig["pattern_reason"], F.when(sig["plain_export"], F.concat(F.lit("Named after primary export: "), sig["export"])))
    name = F.coalesce(pattern, file_name)
    name = once(name, lambda n: F.when(
        sig["export"].isNotNull() & ((n == "unknown") | F.startswith(n, F.lit("snippet_"))), exported).otherwise(n))
    main = sig["main"] & pattern.isNull()
    name = F.when(main, F.concat(F.lit("main"), ext)).otherwise(name)
    name = once(name, lambda n: F.when(sig["test"], _test_name(n, language, ext)).otherwise(n))
    parts = F.filter(F.split(sig["route_path"], "/"), lambda x: x != "")
    route = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("route"))
    component_ext = (F.when(language == "typescript", F.lit(".tsx")).when(language == "vue", F.lit(".vue"))
                     .when(language == "svelte", F.lit(".svelte")).otherwise(F.lit(".jsx")))
    for flag, proposal in (
            ("config", sig["config_name"]), ("component", F.concat(sig["component_name"], component_ext)), ("route", F.concat(route, ext)),
            ("model", F.concat(F.lower(sig["model_name"]), ext)), ("middleware", F.concat(F.lit("middleware"), ext)),
            ("utility", F.coalesce(exported, F.concat(F.lit("utils"), ext))), ("hook", F.concat(sig["hook_name"], ext)),
            ("service", F.concat(F.lower(sig["service_name"]), ext))):
        name = F.when(sig[flag], proposal).otherwise(name)
    made = {"pattern": pattern.isNotNull(), "export": sig["export"].isNotNull(), **{k: sig[k] for k in SIGNALS}, "main": main}
    confidence = F.greatest(F.lit(CONFIDENCE["none"]), *[F.when(v, F.lit(CONFIDENCE[k])).otherwise(F.lit(0.0)) for k, v in made.items()])
    reasons = F.concat_ws("; ", F.concat(F.lit("Pattern match: "), why), F.concat(F.lit("Export: "), sig["export"]),
                          *[F.when(made[k], F.lit(REASONS[k])) for k in SIGNALS])
    return name, confidence, F.when(reasons == "", F.lit("No specific pattern detected")).otherwise(reasons)
