"""Sources: part files, image folders, layout documents, run provenance and settings."""

from __future__ import annotations

import ast
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The part of a layout document that is read.
LAYOUT = "struct<texts: array<struct<label: string, content_layer: string, text: string, prov: array<struct<bbox: struct<l: double, t: double, r: double, b: double>>>>>>"


def read_parts(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """All ``part-*.parquet`` under a folder (or the one file), with ``row_ord``, and their number.

    ``row_ord`` orders rows by file name, then place in the file.
    """
    place = path if path.endswith(".parquet") else f"{path.rstrip('/')}/part-*.parquet"
    df = spark.read.option("mergeSchema", "true").parquet(place)
    names = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())  # one row a file
    files = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "__file string, __n long")
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__i"))
    # Within a file, ids rise with the block and the row.
    order = F.struct("__n", "__block", "__i")
    return rows.join(F.broadcast(files), "__file").withColumn("row_ord", order).drop("__file", "__block", "__i", "__n"), len(names)


def union_globs(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Scorecards of several globs, each file once; needs model and page_id."""
    found = spark.read.option("mergeSchema", "true").parquet(*sorted(set(patterns)))
    missing = {"model", "page_id"} - set(found.columns)
    if missing:
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    return found


def image_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "tif", "tiff", "webp")) -> DataFrame:
    """(path, rel, md): images below a folder and the text file each would have; clashes are refused."""
    base = folder.rstrip("/") + "/"
    glob = "*.{" + ",".join(x for e in extensions for x in (e, e.upper())) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(base).select("path", "length")
    rel = F.substring_index("path", base, -1)
    out = files.select("path", "length", rel.alias("rel"), F.regexp_replace(rel, r"\.[^./]+$", ".md").alias("md"))
    twice = out.groupBy("md").count().where("count > 1").select("md").limit(3).collect()
    if twice:
        raise ValueError(f"several images would share {[r[0] for r in twice]}")
    return out


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def layout(document: Column) -> Column:
    """The items of a layout document given as JSON; none where it has none."""
    return F.coalesce(F.from_json(document, LAYOUT)["texts"], F.array().cast("array<struct<label: string, content_layer: string, text: string, prov: array<struct<bbox: struct<l: double, t: double, r: double, b: double>>>>>"))


def layer_text(document: Column, layer: str) -> Column:
    """Texts of one layer (``body`` or ``furniture``), a line each."""
    items = F.filter(layout(document), lambda t: (t["content_layer"] == layer) & (F.coalesce(t["text"], F.lit("")) != ""))
    return F.array_join(F.transform(items, lambda t: t["text"]), "\n")


def regions(document: Column) -> Column:
    """JSON array of (label, text) of all items with text."""
    items = F.filter(layout(document), lambda t: F.coalesce(t["text"], F.lit("")) != "")
    return F.to_json(F.transform(items, lambda t: F.struct(t["label"].alias("label"), t["text"].alias("text"))))


def read_provenance(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict) or not found:
        raise ValueError("run provenance must be a JSON object with fields")
    return found


#: Request settings: type, least and greatest value (fixed values).
SETTINGS = {"max_tokens": (int, 1, None), "temperature": (float, 0.0, 2.0), "top_p": (float, 0.0, 1.0), "presence_penalty": (float, -2.0, 2.0), "frequency_penalty": (float, -2.0, 2.0), "seed": (int, None, None), "extra_body": (dict, None, None)}
DEFAULTS = {"max_tokens": 16384, "temperature": 0}


def request_settings(text: str | None) -> dict:
    """Strict JSON over the defaults: no duplicate or unknown keys, no NaN, values in range."""
    def pairs(found: list) -> dict:
        keys = [k for k, _ in found]
        if len(set(keys)) < len(keys):
            raise ValueError("a key occurs twice")
        return dict(found)

    def constant(name: str) -> None:
        raise ValueError(f"{name} is not allowed")

    made = json.loads(text, object_pairs_hook=pairs, parse_constant=constant) if text else {}
    if not isinstance(made, dict):
        raise ValueError("settings must be a JSON object")
    for key, value in made.items():
        if key not in SETTINGS:
            raise ValueError(f"unknown setting {key}")
        kind, low, high = SETTINGS[key]
        fits = isinstance(value, (int, float) if kind is float else kind) and not isinstance(value, bool)
        if not fits or (kind is not dict and (not math.isfinite(value) or (low is not None and value < low) or (high is not None and value > high))):
            raise ValueError(f"bad value for {key}")
    clash = set(made.get("extra_body", {})) & (set(SETTINGS) | set(DEFAULTS))
    if clash:
        raise ValueError(f"extra_body repeats {', '.join(sorted(clash))}")
    return DEFAULTS | made


def literal_from_module(path: str, name: str) -> object:
    """A literal assigned at the top of a source file, without running it."""
    with open(path, encoding="utf-8") as f:
        tree = ast.parse(f.read())
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) and node.value else []
        if any(isinstance(t, ast.Name) and t.id == name for t in targets):
            return ast.literal_eval(node.value)
    raise KeyError(name)
