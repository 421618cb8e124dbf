"""Directory trees: found in texts, turned into paths, and drawn from paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.functions import paths as P
from codeloom.functions.text import strip
from codeloom.session import cut_lineage

CHARS = "├└│─┬┼"
BOX = f"[{CHARS}]"
NAME_PREFIX = r"^[│├└─\s┬┼]*"

# Lines of one text come from one input row: windows and folds over a text are bounded by it.


def tree_lines(texts: DataFrame, key: str = "text_id", text: str = "text") -> DataFrame:
    """Lines of trees: runs of two or more neighbouring lines with box characters, numbered per text."""
    rows = texts.where(F.col(text).rlike(BOX)).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    boxed = rows.where(F.col("line").rlike(BOX))
    w = Window.partitionBy(key).orderBy("pos")
    runs = boxed.withColumn("run", F.col("pos") - F.row_number().over(w))
    sized = runs.withColumn("n", F.count("*").over(Window.partitionBy(key, "run"))).where("n >= 2")
    return sized.withColumn("tree_id", F.dense_rank().over(Window.partitionBy(key).orderBy("run")) - 1).select(
        key, "tree_id", "pos", "line")


def depth(line: Column | str) -> Column:
    """Number of leading four-character pieces that hold a box character or a blank."""
    line = F.col(line) if isinstance(line, str) else line
    pieces = F.regexp_extract_all(line, F.lit(r"[\s\S]{1,4}"), F.lit(0))
    flags = F.transform(pieces, lambda p: p.rlike(f"[{CHARS} ]"))
    first_other = F.array_position(flags, False)
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(flags)).cast("int")


def name(line: Column | str) -> Column:
    return strip(F.regexp_replace(line if isinstance(line, Column) else F.col(line), NAME_PREFIX, ""))


def tree_nodes(lines: DataFrame, key: str = "text_id") -> DataFrame:
    """Nodes with depth, full path, leaf flag: an ordered fold that keeps the stack of open ancestors."""
    entry = F.struct("pos", depth("line").alias("depth"), name("line").alias("name"))
    trees = lines.groupBy(key, "tree_id").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    trees = trees.withColumn("e", F.filter("e", lambda x: x["name"] != ""))
    kind = ("struct<stack:array<struct<depth:int,path:string>>,"
            "out:array<struct<pos:int,depth:int,name:string,path:string,level:int>>>")

    def step(acc: Column, e: Column) -> Column:
        open_ = F.filter(acc["stack"], lambda s: s["depth"] < e["depth"])
        parent = F.get(open_, F.size(open_) - 1)
        path = F.when(parent.isNull(), e["name"]).otherwise(F.concat(parent["path"], F.lit("/"), e["name"]))
        node = F.struct(e["pos"].alias("pos"), e["depth"].alias("depth"), e["name"].alias("name"), path.alias("path"),
                        (F.size(open_) + 1).alias("level"))
        return F.struct(F.concat(open_, F.array(F.struct(e["depth"].alias("depth"), path.alias("path")))).alias("stack"),
                        F.concat(acc["out"], F.array(node)).alias("out")).cast(kind)

    start = F.from_json(F.lit('{"stack":[],"out":[]}'), kind)
    folded = F.aggregate("e", start, step, lambda acc: acc["out"])
    nodes = trees.select(key, "tree_id", F.explode(folded).alias("n")).select(key, "tree_id", "n.*")
    following = F.lead("depth").over(Window.partitionBy(key, "tree_id").orderBy("pos"))
    return nodes.withColumn("is_leaf", F.coalesce(following <= F.col("depth"), F.lit(True)))


def tree_summary(nodes: DataFrame, key: str = "text_id") -> DataFrame:
    return nodes.groupBy(key, "tree_id").agg(F.count_if("is_leaf").alias("files"), F.count_if(~F.col("is_leaf")).alias("directories"),
                                             F.max("level").alias("depth"))


def project_tree_paths(blocks: DataFrame) -> DataFrame:
    """``page_id, name, path, pos`` of files in the project trees among a page's blocks.

    Indentation width is the level; a line without extension or with a trailing slash is a folder.
    """
    has_tree = F.col("code").contains("├──") | F.col("code").contains("└──") | F.col("code").rlike(r"(?:^|\n)\s*\|-\s+")
    pattern = r"^([│├└─|\s\-]*)(.+)$"
    lines = F.filter(F.split("code", "\n"), lambda x: strip(x) != "")
    entry = F.transform(lines, lambda x, i: F.struct(
        i.alias("pos"), F.length(F.regexp_extract(x, pattern, 1)).alias("level"), strip(F.regexp_extract(x, pattern, 2)).alias("name")))
    kind = "struct<stack:array<struct<level:int,path:string>>,out:array<struct<pos:int,name:string,path:string>>>"

    def step(acc: Column, e: Column) -> Column:
        open_ = F.filter(acc["stack"], lambda s: s["level"] < e["level"])
        parent = F.get(open_, F.size(open_) - 1)
        bare = strip(F.regexp_replace(e["name"], "/$", ""))
        path = F.when(parent.isNull() | (parent["path"] == ""), bare).otherwise(F.concat(parent["path"], F.lit("/"), bare))
        folder = e["name"].endswith("/") | ~bare.contains(".")
        grown = F.struct(F.concat(open_, F.array(F.struct(e["level"].alias("level"), path.alias("path")))).alias("stack"), acc["out"].alias("out"))
        listed = F.struct(open_.alias("stack"), F.concat(acc["out"], F.array(F.struct(
            e["pos"].alias("pos"), bare.alias("name"), path.alias("path")))).alias("out"))
        return F.when(folder, grown.cast(kind)).otherwise(listed.cast(kind))

    start = F.from_json(F.lit('{"stack":[],"out":[]}'), kind)
    found = F.aggregate(entry, start, step, lambda acc: acc["out"])
    rows = blocks.where(has_tree).select("page_id", "block_index", F.explode(found).alias("f"))
    # later blocks and later lines win: one ordered position over the page
    return rows.select("page_id", "f.name", "f.path", (F.col("block_index").cast("bigint") * 2_000_000_000 + F.col("f.pos")).alias("pos"))


def drawn_tree(files: DataFrame) -> DataFrame:
    """Box-drawing lines of every project's tree: ``project_id, sort_key, line``.

    Siblings stand in the order in which their first file arrived. All steps are aggregates
    and joins on (project, node), so a project of any size is spread over the cluster.
    """
    own = files.select("project_id", "path", F.col("file_id").alias("arrival"))
    parts = own.withColumn("prefixes", F.concat(P.ancestors("path"), F.array("path")))
    nodes = parts.select("project_id", "arrival", F.posexplode("prefixes").alias("level", "node"), (F.size("prefixes") - 1).alias("leaf_level"))
    nodes = nodes.groupBy("project_id", "node").agg(
        F.min("arrival").alias("arrival"), F.first("level").alias("level"), F.bool_or(F.col("level") < F.col("leaf_level")).alias("is_dir"))
    # narrow and used several times below
    nodes = cut_lineage(nodes.withColumn("parent", P.directory("node")))
    last = nodes.groupBy("project_id", "parent").agg(F.max(F.struct("arrival", "node")).alias("l"))
    marked = cut_lineage(nodes.join(last, ["project_id", "parent"]).withColumn("is_last", F.col("node") == F.col("l.node")).drop("l"))
    steps = marked.select("project_id", "node", F.explode(F.concat(P.ancestors("node"), F.array("node"))).alias("step"))
    info = marked.select("project_id", F.col("node").alias("step"), F.col("arrival").alias("s_arrival"), F.col("level").alias("s_level"),
                         F.col("is_last").alias("s_last"))
    # one entry per ancestor of a node: bounded by its depth
    chain = steps.join(info, ["project_id", "step"]).groupBy("project_id", "node").agg(F.array_sort(F.collect_list(
        F.struct("s_level", "s_last", "s_arrival", "step"))).alias("c"))
    lines = chain.join(marked.select("project_id", "node", "is_dir"), ["project_id", "node"])
    above = F.slice("c", F.lit(1), F.size("c") - 1)
    indent = F.array_join(F.transform(above, lambda s: F.when(s["s_last"], F.lit("    ")).otherwise(F.lit("│   "))), "")
    own_mark = F.when(F.element_at("c", -1)["s_last"], F.lit("└── ")).otherwise(F.lit("├── "))
    sort_key = F.array_join(F.transform("c", lambda s: F.concat(F.lpad(s["s_arrival"].cast("string"), 19, "0"), s["step"])), "\u0001")
    return lines.select("project_id", "node", sort_key.alias("sort_key"), F.concat(
        indent, own_mark, P.base_name("node"), F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit(""))).alias("line"))
