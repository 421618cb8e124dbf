"""Teams, invites, attribution, deployments, templates and custom site rules as table jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.functions.text import line_count
from codeloom.rules.templates import TEMPLATES, Template


def resolve_invites(invites: DataFrame, teams: DataFrame, members: DataFrame, now: Column) -> DataFrame:
    """Pending, unexpired invites with their team and whether the user belongs to it already."""
    live = invites.where((F.col("status") == "pending") & (F.col("expires_at") > now))
    mine = members.select(F.col("team_id").alias("m_team"), F.col("user_id").alias("m_user"), "role")
    out = live.join(teams, "team_id").join(
        mine, (F.col("team_id") == F.col("m_team")) & (F.col("user_id") == F.col("m_user")), "left")
    return out.withColumn("already_member", F.col("m_user").isNotNull()).withColumn(
        "role", F.coalesce("role", F.lit("member"))).drop("m_team", "m_user")


def attribution(contributions: DataFrame) -> DataFrame:
    """Contributions per project and user: count, first and last. The ordered list is the input itself,
    sorted by (project, user, ts); it is not gathered into one value."""
    return contributions.groupBy("project_id", "user_id").agg(
        F.count("*").alias("contributions"), F.count_distinct("type").alias("kinds"),
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def member_roles(members: DataFrame) -> DataFrame:
    return members.groupBy("team_id", "role").agg(F.count("*").alias("members"))


def deployment_stats(deployments: DataFrame) -> DataFrame:
    """Per provider and, with provider null, overall: totals and success rate in whole percent."""
    won = F.col("status").isin("success", "deployed")
    g = deployments.groupingSets([[F.col("provider")], []], F.col("provider")).agg(
        F.count("*").alias("total"), F.count_if(won).alias("success"), F.count_if(~won).alias("failed"))
    return g.withColumn("success_rate", F.round(F.col("success") / F.col("total") * 100).cast("bigint"))


def newest_first(df: DataFrame, ts: str, key: str, limit: int) -> DataFrame:
    """A page of the newest rows; planned as a top-k, not a full sort."""
    return df.orderBy(F.col(ts).desc(), F.col(key)).limit(limit)


def template_rows(spark: SparkSession, own: DataFrame | None = None) -> DataFrame:
    """Default templates and the user's own, in one table."""
    schema = ("id string, name string, description string, category string, language string, "
              "tags array<string>, files array<struct<path:string,language:string,content:string>>")
    rows = [(x.id, x.name, x.description, x.category, x.language, x.tags, x.files) for x in TEMPLATES]
    base = spark.createDataFrame(rows, schema).withColumn("is_custom", F.lit(False))
    if own is None:
        return base
    return base.unionByName(own.select(*base.columns[:-1]).withColumn("is_custom", F.lit(True)))


def search_templates(templates: DataFrame, text: str | None = None, category: str | None = None,
                     language: str | None = None, tag: str | None = None) -> DataFrame:
    out = templates
    if category is not None:
        out = out.where(F.col("category") == category)
    if language is not None:
        out = out.where(F.col("language") == language.lower())
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    if text is not None:
        low = text.lower()
        test = F.exists("tags", lambda x: F.lower(x).contains(low))
        for c in ("name", "description", "category", "language"):
            test = test | F.lower(c).contains(low)
        out = out.where(test)
    return out


def template_stats(templates: DataFrame) -> DataFrame:
    """Counts by category and by language in long form, with the overall row."""
    return templates.groupingSets([[F.col("category")], [F.col("language")], []], F.col("category"), F.col("language")).agg(
        F.count("*").alias("templates"), F.count_if(F.col("is_custom")).alias("custom"))


def instantiate(requests: DataFrame, templates: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Files of every requested project, from its template, with per-path override contents."""
    files = templates.select(F.col("id").alias("template_id"), F.explode("files").alias("f")).select("template_id", "f.*")
    out = requests.join(files, "template_id")
    if overrides is not None:
        o = overrides.select(F.col("project_id").alias("o_project"), F.col("path").alias("o_path"), F.col("content").alias("o_content"))
        out = out.join(o, (F.col("project_id") == F.col("o_project")) & (F.col("path") == F.col("o_path")), "left").withColumn(
            "content", F.coalesce(F.when(F.col("o_content") != "", F.col("o_content")), F.col("content"))).drop(
            "o_project", "o_path", "o_content")
    return out.withColumn("size", F.length("content")).withColumn("lines", line_count("content"))


def validate_site_rules(rules: DataFrame) -> DataFrame:
    """Findings of user-made rules: name, domain and at least one selector are required."""
    checks = F.array(
        F.when(F.coalesce("name", F.lit("")) == "", F.lit("Parser name is required")),
        F.when(F.coalesce("domain", F.lit("")) == "", F.lit("Domain is required")),
        F.when(F.coalesce(F.size("selectors"), F.lit(0)) <= 0, F.lit("At least one selector is required")))
    return rules.select("rule_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("message"))
