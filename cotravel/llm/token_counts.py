"""Token counts of document sections from one encoding of the whole text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encode
from .shared import text_udf

RULES = ("start", "majority", "split")
SCHEMA = "array<struct<section:int,start:int,end:int,n_tokens:double,n_crossing:int>>"


def lines(text: str) -> np.ndarray:
    """Line starts in code points and the text's length; a line's end mark belongs to it."""
    cuts, at = [0], text.find("\n")
    while at >= 0:
        if at + 1 < len(text):
            cuts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array([*cuts, len(text)] if text else [0, 0], np.int64)


def parted(sections: list[dict], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(cuts of the whole text, which of its parts are the sections): the gaps between sections are parts too."""
    cuts, which = [0], []
    for s in sections:
        a, b = min(s["start"], length), min(s["end"], length)
        if a < cuts[-1] or b < a:
            raise ValueError("sections must be ascending and must not overlap")
        if a > cuts[-1]:
            cuts.append(a)
        which.append(len(cuts) - 1)
        cuts.append(b)
    if cuts[-1] < length or len(cuts) == 1:
        cuts.append(length)
    return np.array(cuts, np.int64), np.array(which, np.int64)


def allocate(cuts: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross a boundary) of the parts cuts[i]:cuts[i + 1].

    A token lies in the part that holds its first character. A token that crosses boundaries goes to that
    part under "start", to the part with most of its characters (the first of equals) under "majority",
    and in shares by characters under "split". Parts of no length have no tokens.
    """
    n = len(cuts) - 1
    first = np.clip(np.searchsorted(cuts, lo, "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(cuts, np.maximum(hi - 1, lo), "right") - 1, 0, n - 1)
    crossing = first != last
    count = np.bincount(first[~crossing], minlength=n).astype(np.float64)
    crossed = np.zeros(n, np.int64)
    for k in np.flatnonzero(crossing):
        over = np.arange(first[k], last[k] + 1)
        part = np.minimum(cuts[over + 1], hi[k]) - np.maximum(cuts[over], lo[k])
        over, part = over[part > 0], part[part > 0]
        crossed[over] += 1
        if rule == "start":
            count[first[k]] += 1
        elif rule == "majority":
            count[over[np.argmax(part)]] += 1
        else:
            count[over] += part / part.sum()
    return count, crossed


def count_udf(path: str, rule: str):
    def run(col: pa.Array) -> pa.Array:
        texts, enc = [t or "" for t in col.field(0).to_pylist()], encode.encoder(path, spans=True)
        given = col.field(1).to_pylist() if col.type.num_fields > 1 else None
        sizes, idx, starts, ends, counts, crossings = [], [], [], [], [], []
        for i, j in encode.groups(texts):
            _, total, lo, hi = enc.encode(texts[i:j])
            bounds = np.concatenate([[0], np.cumsum(total)])
            for k, t in enumerate(texts[i:j]):
                if given is None:
                    cuts = lines(t)
                    which = np.arange(len(cuts) - 1)
                else:
                    cuts, which = parted(given[i + k] or [], len(t))
                n, crossed = allocate(cuts, lo[bounds[k] : bounds[k + 1]], hi[bounds[k] : bounds[k + 1]], rule)
                sizes.append(len(which))
                idx.append(np.arange(len(which), dtype=np.int32))
                starts.append(cuts[which])
                ends.append(cuts[which + 1])
                counts.append(n[which])
                crossings.append(crossed[which])
        cat = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))
        rows = pa.StructArray.from_arrays(
            [cat(idx, np.int32), cat(starts, np.int32), cat(ends, np.int32), cat(counts, np.float64), cat(crossings, np.int32)],
            ["section", "start", "end", "n_tokens", "n_crossing"],
        )
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), rows)

    return run


def with_fields(docs: DataFrame, fields: list[str], separator: str = "\n") -> DataFrame:
    """doc_id, text (the fields' texts, null as empty, with ``separator`` between) and sections, the fields' places in it:
    one encoding of the text then counts the tokens of each field (section k is field k)."""
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in fields]
    places, at = [], F.lit(0)
    for t in texts:
        places.append(F.struct(at.cast("int").alias("start"), (at + F.char_length(t)).cast("int").alias("end")))
        at = at + F.char_length(t) + len(separator)
    return docs.select("doc_id", F.concat_ws(separator, *texts).alias("text"), F.array(*places).alias("sections"))


def token_counts(docs: DataFrame, tokenizer: str, rule: str = "majority", sections: str | None = None) -> DataFrame:
    """One row per section of each document: doc_id, section, start, end, n_tokens, n_crossing.

    The text is encoded once as a whole and each token's character span is joined to the sections' intervals;
    ``rule`` says who gets a token that crosses a boundary (see ``allocate``). Sections are the intervals that the
    column ``sections`` (an array of (start, end) in code points, ascending, disjoint, cut to the text's length) holds,
    the lines of the text where none is named. What lies between sections counts as a part that isn't returned; where
    the sections cover the text, a document's counts add up to its tokens. A null or empty text has no tokens (and one
    empty line); null or no sections give no rows. Repeated rows are counted each; a null doc_id stays null. Texts
    are encoded whole, however long. No rows: no rows. Other columns aren't read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    count = text_udf(__name__, "count_udf", SCHEMA, tokenizer, rule)
    text = F.col("text").cast("string").alias("text")
    data = F.struct(text) if sections is None else F.struct(text, F.col(f"`{sections}`").cast("array<struct<start:int,end:int>>").alias("sections"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(count(data)).alias("s")).select("doc_id", "s.*")
