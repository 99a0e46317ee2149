"""Sinks: scorecard files, part names, static boards, review pages, provenance and commands."""

from __future__ import annotations

import html
import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_scorecards(rows: DataFrame) -> DataFrame:
    """Nested cells as JSON strings, others unchanged."""
    nested = [f.name for f in rows.schema if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType))]
    return rows.withColumns({c: F.to_json(c) for c in nested}) if nested else rows


def write_verified(rows: DataFrame, path: str) -> DataFrame:
    """Write, read back, compare row count and columns."""
    rows.write.mode("overwrite").parquet(path)
    again = rows.sparkSession.read.parquet(path)
    if again.count() != rows.count() or again.columns != rows.columns:
        raise OSError(f"{path} does not hold what was written")
    return again


def replace_file(path: str, data: str) -> None:
    """Write beside the file, then rename: a failure leaves the old file."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, part = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(data)
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def write_parquet(table: pa.Table, uri: str) -> None:
    """One file, in any file system that Arrow reaches; it appears under its name once it is whole."""
    store, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    pq.write_table(table, part, filesystem=store)
    store.move(part, path)


_PART = re.compile(r"part-r(\d{2,})-(\d{5,})\.parquet")


def part_name(rank: int, index: int) -> str:
    return f"part-r{rank:02d}-{index:05d}.parquet"


def next_part_index(names: list[str], rank: int) -> int:
    """One more than the greatest index of the rank; holes are not filled, other names ignored."""
    return max((int(m[2]) for n in names if (m := _PART.fullmatch(os.path.basename(n))) and int(m[1]) == rank), default=-1) + 1


def write_texts(rows: DataFrame, folder: str, rel: str = "md", text: str = "text") -> int:
    """A text file per row below a folder that executors share; returns how many."""
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for name, value in zip(batch[rel], batch[text], strict=True):
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                replace_file(path, value or "")
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select(rel, text).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def archive(folder: str, names: list[str], now: datetime | None = None) -> str:
    """Move files into ``archived-<UTC stamp>``."""
    target = os.path.join(folder, f"archived-{(now or datetime.now(UTC)):%Y%m%dT%H%M%SZ}")
    os.makedirs(target)
    for name in names:
        os.replace(os.path.join(folder, name), os.path.join(target, os.path.basename(name)))
    return target


def board_rows(board: dict, meta: dict[str, dict]) -> tuple[list[dict], list[str]]:
    """Rows by rate with the models' descriptions, and models whose every page failed."""
    rows, excluded = [], []
    for name in board["order"]:
        if name not in meta:
            raise KeyError(f"no description of {name}")
        card = board["scorecards"][name]
        if card["n"] == 0:
            excluded.append(name)
            continue
        rows.append({"model": name, **meta[name], **{k: card[k] for k in ("cer_reading_micro", "cer_ci", "recall_micro", "over_extraction_micro", "truncation_rate", "eligible")}})
    return sorted(rows, key=lambda r: (r["cer_reading_micro"] is None, r["cer_reading_micro"] or 0.0)), excluded


def bake(page: str, name: str, value: object) -> str:
    """Replace what stands between the page's markers for ``name`` by JSON."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    if page.count(begin) != 1 or page.count(end) != 1:
        raise ValueError(f"the page must have one block {name}")
    head, rest = page.split(begin)
    data = json.dumps(value, ensure_ascii=False, default=str).replace("</", "<\\/")
    return f'{head}{begin}\n<script type="application/json" id="{name}">{data}</script>\n{end}{rest.split(end, 1)[1]}'


def review_page(rows: DataFrame, limit_conf: float, first_prefix: str, image: Callable[[bytes], str] | None = None) -> str:
    """Cards of doubtful pages: one volume family first, then by volume and confidence."""
    order = F.when(F.startswith("volume", F.lit(first_prefix)), 0).otherwise(1)
    doubtful = rows.where(F.col("conf") < limit_conf).orderBy(order, "volume", "conf")
    cards = []
    for r in doubtful.toLocalIterator():
        picture = f'<img src="{image(r["image"])}">' if image and "image" in doubtful.columns else ""
        cards.append(f'<div class="card" data-id="{html.escape(str(r["page_id"]))}"><b>{html.escape(str(r["volume"]))}</b> {html.escape(str(r["label"]))} {r["conf"]:.3f}{picture}<pre>{html.escape(r["text"] or "")}</pre></div>')
    return "<!DOCTYPE html>\n<meta charset=utf-8>\n" + "\n".join(cards) + "\n"


def run_provenance(outputs: DataFrame, fields: dict, key: str = "page_id", text: str = "raw") -> dict:
    """A run's description with row and id counts and a hash of its outputs that no order changes."""
    row = outputs.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("unique"), F.sha2(F.concat(F.sum(F.xxhash64(key, text).cast("decimal(38,0)")).cast("string"), F.lit("/"), F.count("*").cast("string")), 256).alias("sha256")).first()
    return {**fields, "outputs": row.asDict()}


def launch_script(plan: list[dict], cache: dict[str, str], look_up: Callable[[str], str]) -> tuple[str, dict[str, str]]:
    """Commands of a plan; revisions are looked up only where the cache has none."""
    known = dict(cache)
    lines = ["#!/bin/sh", "set -eu"]
    for job in plan:
        if job["model"] not in known:
            known[job["model"]] = look_up(job["model"])
        lines.append(" ".join([job["command"], f"--model {job['model']}", f"--revision {known[job['model']]}", *(f"--{k} {v}" for k, v in sorted(job.get("options", {}).items()))]))
    return "\n".join(lines) + "\n", known


def append_info(column: str, entry: dict):
    """A JSON array column with one more entry."""
    old = F.coalesce(F.from_json(F.col(column), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    new = F.create_map(*(F.lit(str(x)) for kv in entry.items() for x in kv))
    return F.to_json(F.array_append(old, new))


def dataset_card(name: str, fields: dict, counts: dict[str, int]) -> str:
    """A Markdown card with JSON front matter values: what a dataset is and how many rows it has by status."""
    head = ["---", *(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in sorted(fields.items())), "---", "", f"# {name}", ""]
    return "\n".join([*head, "| status | rows |", "|---|---|", *(f"| {k} | {n} |" for k, n in sorted(counts.items())), ""])
