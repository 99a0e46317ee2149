"""Producers' answers as columns, requests' identities, and what a run would cost."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.operators import consolidate

_USAGE = ("prompt_tokens", "completion_tokens")


def parse_answer(body: Column) -> dict[str, Column]:
    """Columns of a chat completion body; a missing text is the empty one."""
    get = lambda p: F.get_json_object(body, p)
    return {
        "raw": F.coalesce(get("$.choices[0].message.content"), F.lit("")),
        "finish_reason": get("$.choices[0].finish_reason"),
        "model": get("$.model"),
        **{u: get(f"$.usage.{u}").cast("long") for u in _USAGE},
    }


def front_matter(text: Column) -> Column:
    """Flat ``key: value`` front matter as a JSON object; null where there is none."""
    block = F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[^:\s]+\s*:"))
    pair = lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value"))
    return F.when(block != "", F.to_json(F.map_from_entries(F.transform(lines, pair))))


def page_status(blocks: Column) -> Column:
    """``length`` if any block failed yet has text (it was cut off), else ``stop``."""
    parsed = F.from_json(blocks, "array<struct<error: boolean, html: string>>")
    cut = F.exists(parsed, lambda b: F.coalesce(b["error"], F.lit(False)) & (F.coalesce(b["html"], F.lit("")) != ""))
    return F.when(F.coalesce(cut, F.lit(False)), "length").otherwise("stop")


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    """Rows by status, all errors together."""
    return rows.groupBy(F.when(F.startswith(status, F.lit("error")), "error").otherwise(F.col(status)).alias(status)).agg(F.count("*").alias("n"))


def image_bytes(cell: Column, kind: str) -> Column:
    """Image bytes of a binary cell or of a struct with ``bytes``."""
    if kind == "binary":
        return cell
    if kind.startswith("struct") and "bytes:binary" in kind.replace(" ", ""):
        return cell["bytes"]
    raise TypeError(f"{kind} holds no image")


def data_url(image: Column, mime: str = "image/jpeg") -> Column:
    # Some versions break lines after 76 characters, which a URL must not have.
    return F.concat(F.lit(f"data:{mime};base64,"), F.translate(F.base64(image), "\r\n", ""))


def jpeg(most: int = 1536, quality: int = 90) -> Callable[[bytes], bytes]:
    """An image as an RGB JPEG within ``most`` pixels a side; needs an imaging package."""
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("re-encoding images needs Pillow") from e
    from io import BytesIO

    def encode(data: bytes) -> bytes:
        image = Image.open(BytesIO(data)).convert("RGB")
        image.thumbnail((most, most))
        out = BytesIO()
        image.save(out, "JPEG", quality=quality)
        return out.getvalue()

    return encode


def encoded_url(image: Column, encode: Callable[[bytes], bytes], mime: str = "image/jpeg") -> Column:
    """The data URL of images that ``encode`` (see ``jpeg``) has made over."""
    @F.pandas_udf("binary")
    def run(cells: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else encode(bytes(c)) for c in cells], dtype=object)

    return data_url(run(image), mime)


def with_images(pages: DataFrame, images: DataFrame, path: str = "image_path") -> DataFrame:
    """Metadata rows of a pinned source with the bytes of their images; a row without its image is refused."""
    joined = pages.join(images.select(F.col("path").alias(path), F.col("content").alias("image")), path, "left")
    absent = [r[0] for r in joined.where("image is null").select(path).orderBy(path).limit(3).collect()]
    if absent:
        raise ValueError(f"images are missing: {absent}")
    return joined


def cache_key(settings: dict) -> str:
    """Identity of a request: twelve hexadecimal digits."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:12]


def pin_revision(place: str, revision: str | None, look_up=None) -> str | None:
    """A full commit hash as it is; a local path has none; names are looked up."""
    if place.endswith(".parquet") or place.startswith((".", "/", "file:")):
        return None
    if revision and re.fullmatch("[0-9a-f]{40}", revision):
        return revision
    if look_up is None:
        raise ValueError(f"{revision or 'the default branch'} of {place} cannot be pinned without a look-up")
    found = look_up(place, revision)
    if not re.fullmatch("[0-9a-f]{40}", found or ""):
        raise ValueError(f"{place} has no commit for {revision}")
    return found


def refuse_routed(url: str, hosts: tuple[str, ...]) -> None:
    """Answers from shared routers cannot be attributed to one model revision."""
    host = (urlsplit(url).hostname or "").lower()
    if any(host == h or host.endswith("." + h) for h in hosts):
        raise ValueError(f"{host} routes requests to hosts that it does not name")


def plan(models: dict[str, str], truth: DataFrame, caches: dict[str, DataFrame], retry_errors: bool = False) -> list[dict]:
    """Pages each model still needs, and the totals in the last row."""
    wanted = truth.select(F.col("page_key").alias("page_id"))
    total = wanted.count()
    rows = [{"model": m, "url": u, "pending": consolidate.pending(wanted, caches[m], retry_errors=retry_errors).count() if m in caches else total} for m, u in models.items()]
    return [*rows, {"model": "total", "url": None, "pending": sum(r["pending"] for r in rows)}]


def check_plan(made: list[dict], limit: int | None, consent: bool, out: str, scorecards: str) -> None:
    """Refuse before any request: missing consent, too many requests, or a board among its own inputs."""
    need = made[-1]["pending"]
    if need and not consent:
        raise ValueError(f"{need} requests need consent")
    if limit is not None and need > limit:
        raise ValueError(f"{need} requests are more than {limit}")
    if (out.rstrip("/") + "/").startswith(scorecards.rstrip("/") + "/"):
        raise ValueError("the combined output must not lie among the scorecards")


def cached_rows(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """Cached answers that may be scored: known unique pages, strings only."""
    for c in ("page_id", "raw"):
        if c not in rows.columns:
            raise ValueError(f"{c} is missing")
    if dict(rows.dtypes)["raw"] != "string":
        raise ValueError("answers must be strings")
    if not rows.groupBy("page_id").count().where("count > 1").isEmpty():
        raise ValueError("a page occurs twice")
    if not rows.join(truth.select(F.col("page_key").alias("page_id")), "page_id", "left_anti").isEmpty():
        raise ValueError("a page is not in the ground truth")
    return rows.withColumn("error", F.startswith("raw", F.lit(C.ERROR_PREFIX)))
