"""Language of web pages: text, declared markup, address and host priors, fused as Bayesian evidence."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allocora.llm.common import written
from allocora.runtime import collect_bounded, small_table

#: Buckets of character trigrams; the text model has one row of this many numbers per language.
BUCKETS = 1 << 15
MAX_LANGUAGES = 100
#: Neighbouring trigrams say much the same, so a text's log likelihood counts this much, and at most as many as so many trigrams.
TEMPER, MOST_TRIGRAMS = 0.3, 600
#: Pseudo-counts that a level of the hierarchy takes from the level above, and of evidence tables.
BORROWED, SMOOTHING = 5.0, 0.5

_DROPPED = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript)\b[^>]*>.*?</\1\s*>")
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = re.compile(r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})")
_DECLARED_META = re.compile(r"(?i)<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?([a-z]{2,3})")
_ADDRESS = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?(/[^?#]*)?", re.IGNORECASE)


def visible_text(page: str | None) -> str:
    return html.unescape(_TAG.sub(" ", _DROPPED.sub(" ", page or "")))


def trigrams(text: str) -> np.ndarray:
    """Buckets of all character trigrams of a text, lower-cased, blanks run together."""
    found = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(found) < 3:
        return np.zeros(0, np.int64)
    mixed = (found[:-2] * np.uint64(1_000_003) + found[1:-1]) * np.uint64(1_000_003) + found[2:]
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)


def address_parts(url: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """Host, its last two labels, its last label and a two-letter first step of the path, in lower case."""
    found = _ADDRESS.match((url or "").strip())
    if found is None or not found[1]:
        return None, None, None, None
    host = found[1].lower().rstrip(".")
    labels = host.split(".")
    step = (found[2] or "").split("/")[1:2]
    return host, ".".join(labels[-2:]), labels[-1], step[0].lower() if step and re.fullmatch("[A-Za-z]{2}", step[0]) else None


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages of the labelled documents, and the log share of each trigram bucket in each.

    Counts cover every labelled document; each task adds up its own before they meet.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in counts:
                    if len(counts) >= MAX_LANGUAGES:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                counts[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, found in counts.items():
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(found[some])],
                names=["lang", "bucket", "count"],
            )

    summed = known.select("lang", "text").mapInArrow(run, "lang string, bucket int, count long").groupBy("lang", "bucket").agg(F.sum("count").alias("count"))
    rows = summed.limit(MAX_LANGUAGES * BUCKETS + 1).toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    counts = np.full((len(languages), BUCKETS), SMOOTHING)
    place = {lang: at for at, lang in enumerate(languages)}
    lang = np.array([place[x] for x in rows["lang"].to_pylist()], np.int64)
    counts[lang, rows["bucket"].to_numpy()] += rows["count"].to_numpy()
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _posterior(logs: list[Column]) -> list[Column]:
    """Shares of languages from sums of logs."""
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    parts = [F.exp(c - top) for c in logs]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Join a table with one row per key, null keys included; a table that is not proven small is joined by a shuffle."""
    table = small_table(table.withColumnRenamed(key, "__key"))
    return rows.join(table, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, language, probability, text_language, declared and host of every page.

    The visible text of the whole page is scored by character trigrams. What its
    posterior says is summed by host, domain, last label, declared language and
    path language, each group combined in its tasks before it meets. From the
    sums come P(declared | language) and P(path | language), and the host's prior,
    which is smoothed by the domain's, that by the last label's, that by all
    pages'. A page's own share is taken out of its groups before they speak for it.
    Languages are those of ``docs.lang``.

    A null or empty page is judged by its address, a null address by the rest; pages
    without a host are a group of their own at each level of the prior;
    without any evidence the commonest language wins. Ties go to the language that
    comes first. Repeated rows are answered each. Without labelled documents the
    language is null. Other columns are ignored.
    """
    languages, logs = text_model(docs)
    n = len(languages)
    if not n:
        none = F.lit(None).cast("string")
        return pages.select(
            "page_id", none.alias("language"), F.lit(None).cast("double").alias("probability"), none.alias("text_language"), none.alias("declared"), none.alias("host")
        )
    schema = T.StructType(
        [
            pages.schema["page_id"],
            *(T.StructField(c, T.StringType()) for c in ("host", "domain", "suffix", "path", "declared")),
            *(T.StructField(f"l{k}", T.DoubleType()) for k in range(n)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(logs.T)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                parts, scores = [], []
                for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    found = trigrams(visible_text(page))
                    declared = _DECLARED.search(page or "") or _DECLARED_META.search(page or "")
                    parts.append((*address_parts(url), declared[1].lower() if declared else None))
                    mean = table[found].mean(axis=0, dtype=np.float64) if len(found) else np.zeros(n)
                    scores.append(mean * TEMPER * min(len(found), MOST_TRIGRAMS))
                columns = [pa.array(c, pa.string()) for c in zip(*parts, strict=True)]
                columns += [pa.array(c) for c in np.ascontiguousarray(np.array(scores).T)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    scored = pages.select("page_id", "url", "html").mapInArrow(run, schema)
    likes = [F.col(f"l{k}") for k in range(n)]
    rows = written(scored.withColumns({f"p{k}": p for k, p in enumerate(_posterior(likes))}), "pages")

    def sums(by: str, prefix: str) -> DataFrame:
        return rows.groupBy(by).agg(*(F.sum(f"p{k}").alias(f"{prefix}{k}") for k in range(n)))

    whole = collect_bounded(rows.agg(*(F.coalesce(F.sum(f"p{k}"), F.lit(0.0)) for k in range(n))), 1, "totals")[0]
    grand = sum(whole) + SMOOTHING * n
    fused = rows
    for by, prefix in (("suffix", "s"), ("domain", "d"), ("host", "h"), ("declared", "m"), ("path", "a")):
        fused = _looked_up(fused, sums(by, prefix), by)

    def without_own(prefix: str, k: int) -> Column:
        return F.greatest(F.col(f"{prefix}{k}") - F.col(f"p{k}"), F.lit(0.0))

    prior = [F.lit((whole[k] + SMOOTHING) / grand) for k in range(n)]
    for prefix in ("s", "d", "h"):
        own = [without_own(prefix, k) for k in range(n)]
        size = sum(own[1:], own[0])
        names = [f"prior_{prefix}{k}" for k in range(n)]
        fused = fused.withColumns({name: (own[k] + BORROWED * prior[k]) / (size + BORROWED) for k, name in enumerate(names)})
        prior = [F.col(name) for name in names]

    def evidence(prefix: str, by: str, k: int) -> Column:
        """log P(what is declared | language); what is not there says nothing."""
        return F.when(F.col(by).isNull(), 0.0).otherwise(F.log((without_own(prefix, k) + SMOOTHING) / F.lit(whole[k] + SMOOTHING * (n + 1))))

    total = [F.log(prior[k]) + likes[k] + evidence("m", "declared", k) + evidence("a", "path", k) for k in range(n)]
    fused = fused.withColumns({f"t{k}": c for k, c in enumerate(total)})
    fused = fused.withColumns({f"q{k}": c for k, c in enumerate(_posterior([F.col(f"t{k}") for k in range(n)]))})

    def best(prefix: str) -> Column:
        top = F.greatest(*(F.col(f"{prefix}{k}") for k in range(n))) if n > 1 else F.col(f"{prefix}0")
        return F.coalesce(*(F.when(F.col(f"{prefix}{k}") == top, F.lit(languages[k])) for k in range(n)))

    certain = F.greatest(*(F.col(f"q{k}") for k in range(n))) if n > 1 else F.col("q0")
    return fused.select("page_id", best("q").alias("language"), certain.alias("probability"), best("p").alias("text_language"), "declared", "host")
