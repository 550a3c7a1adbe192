"""URL filter: rules, then a list of canonical URLs behind a blocked Bloom filter.

A canonical URL is ``host path?query``: host lower-cased without a leading ``www.`` and without a default port, path
without a trailing ``/`` and ``index.html``, query parameters sorted without tracking ones, no fragment, no scheme.

The listed URLs set ``HASHES`` bits each in one 512-bit block of a Bloom filter, chosen by their hash.  Tasks look every
URL up there; the possible hits go to an exact join with the list, which removes false positives.  The filter has about
``BITS_PER_URL`` bits for each listed URL but never more than ``MAX_BLOCKS`` blocks (64 MB), so its broadcast is
bounded; a longer list costs more false positives, not results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm import words as W
from faultline.llm.shared import map_arrow

U64 = np.uint64
BITS_PER_URL = 12
HASHES = 8
MAX_BLOCKS = 1 << 20

# Query parameters that only track.
TRACKING = ["fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def path(url: str = "url") -> Column:
    """Behind the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: str = "url") -> Column:
    """Null for a URL without a host."""
    where = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    at = F.regexp_replace(F.regexp_replace(path(url), r"/index\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    tracks = F.array(*[F.lit(t) for t in TRACKING])
    args = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.array_contains(tracks, F.substring_index(p, "=", 1))))
    tail = F.when(F.size(args) > 0, F.concat(F.lit("?"), F.array_join(args, "&"))).otherwise("")
    return F.when(host(url) != "", F.concat(where, at, tail))


def rule_verdict(rules: list[tuple[str, str, str]], host_col: str, path_col: str) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one.  rules: (verdict, host, path); a rule fits
    its host and all subdomains if the path starts with the rule's.  Ties in length: first by text, then block."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0] != "block"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in reversed(order):
        fits = ((F.col(host_col) == h) | F.col(host_col).endswith("." + h)) & F.col(path_col).startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter and mask of each of the HASHES bits of a hash, all in one block of 8 words."""
    g = W.mix(h ^ U64(0x5851F42D4C957F2D))
    block = ((h >> U64(32)) * U64(blocks) >> U64(32)).astype(np.int64)
    word = np.empty((len(h), HASHES), dtype=np.int64)
    bit = np.empty((len(h), HASHES), dtype=U64)
    for j in range(HASHES):
        place = ((g >> U64(j * 7)) + U64(j) * (h & U64(511))) & U64(511)
        word[:, j] = block * 8 + (place >> U64(6)).astype(np.int64)
        bit[:, j] = U64(1) << (place & U64(63))
    return word, bit


def _hash(col: pa.Array) -> np.ndarray:
    """64-bit hash of each whole value (URLs hold no class separator: every byte belongs to the word)."""
    buf, off = W.utf8(col)
    every = np.ones(256, dtype=bool)
    h, at = W.word_hashes(buf, off, every)
    out = np.zeros(len(col), dtype=U64)
    full = np.diff(at) > 0
    out[full] = h[at[:-1][full]]
    return out


def build_filter(listed: DataFrame) -> np.ndarray:
    """listed(canonical), distinct -> words of the filter.  Tasks send set words, merged by bit_or; the driver gets at
    most 8 * MAX_BLOCKS of them."""
    n = listed.count()
    blocks = int(min(MAX_BLOCKS, max(1, -(-n * BITS_PER_URL // 512))))

    def run(batches):
        for batch in batches:
            word, bit = _bits(_hash(batch.column(0)), blocks)
            word, bit = word.ravel(), bit.ravel()
            order = np.argsort(word, kind="stable")
            word, bit = word[order], bit[order]
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else []
            if len(first):
                yield pa.record_batch([pa.array(word[first]), pa.array(np.bitwise_or.reduceat(bit, first).view(np.int64))], names=["word", "bits"])

    rows = map_arrow(listed.select("canonical"), run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(blocks * 8, dtype=np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(U64)


def url_filter(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages(..., url) -> its columns and host, path, rule, canonical, possible, listed, verdict (these replace columns of
    the same names).

    listed(url): blocked URLs.  verdict: the rule's, else block if the canonical URL is listed, else allow.  A null URL
    or one without ``://`` has empty host and path and is never listed.  Every row of pages stays, with repetitions.
    """
    known = listed.select(canonical("url").alias("canonical")).where("canonical IS NOT NULL").distinct()
    shared = pages.sparkSession.sparkContext.broadcast(build_filter(known))
    cols = [c for c in pages.columns if c not in ("host", "path", "rule", "canonical", "possible", "listed", "verdict")]
    rows = pages.select(*cols, host().alias("host"), path().alias("path"), canonical().alias("canonical"))
    names = rows.columns

    def run(batches):
        bits = shared.value
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            word, bit = _bits(_hash(col), len(bits) // 8)
            hit = ((bits[word] & bit) == bit).all(axis=1) & ~col.is_null().to_numpy(zero_copy_only=False)
            yield pa.record_batch(batch.columns + [pa.array(hit)], names=names + ["possible"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = map_arrow(rows, run, f"{kinds}, possible boolean")
    hits = rows.where("possible").join(known.withColumn("listed", F.lit(True)), "canonical", "left")
    hits = hits.withColumn("listed", F.coalesce("listed", F.lit(False)))
    found = hits.unionByName(rows.where("NOT possible").withColumn("listed", F.lit(False)))
    rule, verdict = rule_verdict(rules, "host", "path")
    found = found.withColumn("rule", rule)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return found.withColumn("verdict", F.coalesce(verdict, method))
