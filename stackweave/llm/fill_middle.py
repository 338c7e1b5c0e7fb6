"""Fill-in-the-middle by an indexable skip list over a text's units.

A unit is a word with the white space before it, or the white space at a text's end. The units of a text are the
bottom lane of a skip list; of each lane's nodes a fixed share, chosen by a hash of the place, goes on to the next
express lane. A link carries two widths: how many units and how many code points it passes. Both cuts of a text are
reached from its head by descending the lanes: a query follows a link while the units passed so far and the link's own
do not exceed its rank, and the code points passed add up on the way. The lanes of all texts of a piece are built
together, and their queries descend together, so a cut costs a logarithm of the units.

Cuts and form come from sha256 of "<seed>:<doc_id>": the first four groups of eight hex digits are h1 to h4. Prefix
ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, middle after the larger. A text stays plain if it is
empty or holds a mark, or if h3 % 100 >= rate; else it is spm if h4 % 100 < spm, else psm. No mark can arise across a
boundary, so output and form give the text back.

Null texts count as empty; both have no units and stay plain. A null doc_id hashes as the empty text after the colon.
Repeated rows give the same output each. Very long texts are one piece of their own, in memory of a few dozen bytes a
unit. An empty table gives no rows. Columns of docs pass through; those named like a result, in any case of letters,
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

P, S, M = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 42, 50, 80
#: One of so many nodes of a lane goes on to the next, on average.
FAN = 8
ADDED = ("n_units", "prefix_chars", "middle_chars", "form", "output")
END = np.int64(1) << np.int64(62)


def unit_ends(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends in bytes of all units of the texts, and the first unit of each text."""
    _, end = X.edges(X.NOT_SPACE[buf], at)
    last = np.zeros(len(at) - 1, bool)
    full = np.flatnonzero(np.diff(at))
    last[full] = ~X.NOT_SPACE[buf[at[full + 1] - 1]]  # white space at the end is a unit of its own
    end = np.sort(np.concatenate([end, at[1:][last]]))
    return end, np.searchsorted(end, at, "right")


class SkipList:
    """The lanes over the units of several texts. Each text has a head, which stands in all lanes.

    A lane is three arrays over its nodes in order: the units and the code points that the link to the next node passes
    (END in units at a text's last node), and each node's place in the lane below.
    """

    def __init__(self, units: np.ndarray, chars: np.ndarray) -> None:
        """units: how many each text has; chars: the code points of each unit of all texts."""
        n = len(units) + len(chars)
        self.heads = [np.cumsum(units + 1) - units - 1]
        head = np.zeros(n, bool)
        head[self.heads[0]] = True
        width, passed = np.ones(n, np.int64), np.zeros(n, np.int64)
        passed[np.flatnonzero(~head) - 1] = chars  # node i - 1 leads over unit i
        last = np.append(head[1:], True)[:n]
        width[last], passed[last] = END, 0
        self.lanes = [(width, passed, np.arange(n))]
        place = np.arange(n)  # in the bottom lane
        while len(place) > len(units):
            up = X.mix(place.astype(np.uint64) + np.uint64(len(self.lanes) << 48)) % np.uint64(FAN) == 0
            keep = np.flatnonzero(up | head[place])
            width, passed, _ = self.lanes[-1]
            last = np.append(head[place[keep[1:]]], True)
            far = np.add.reduceat(np.where(width == END, 0, width), keep)
            far[last] = END
            self.lanes.append((far, np.add.reduceat(passed, keep), keep))
            place = place[keep]
            self.heads.append(np.flatnonzero(head[place]))

    def descend(self, text: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(units, code points) passed from the head of each text to its unit of the given rank."""
        at, units, chars = self.heads[-1][text], np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        for width, passed, below in reversed(self.lanes):
            go = np.arange(len(text))
            while len(go):
                go = go[units[go] + width[at[go]] <= rank[go]]
                units[go] += width[at[go]]
                chars[go] += passed[at[go]]
                at[go] += 1
            at = below[at]
        return units, chars


def cuts(buf: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text its units, and the code points before the first and before the second cut."""
    end, first = unit_ends(buf, at)
    units = np.diff(first)
    count = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    begin = np.concatenate([[0], end[:-1]]) if len(end) else end
    lanes = SkipList(units, count[end] - count[begin])
    text = np.arange(len(units))
    low, high = np.minimum(h1 % (units + 1), h2 % (units + 1)), np.maximum(h1 % (units + 1), h2 % (units + 1))
    _, chars = lanes.descend(np.concatenate([text, text]), np.concatenate([low, high]))
    return units, chars[: len(units)], chars[len(units) :]


def group(digest: Column, i: int) -> Column:
    """The i-th group of eight hex digits as a number."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """docs with n_units, form (plain, psm, spm), prefix_chars and middle_chars (null if plain) and the output text."""
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    name = "fim_work"
    while any(c.lower().startswith(name) for c in keep):
        name += "_"
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    body = F.coalesce("text", F.lit(""))
    given = docs.select(*keep, digest.alias(name)).select("*", *(group(F.col(name), i).alias(f"{name}{i}") for i in (0, 1)))
    found = {"n_units": "long", f"{name}p": "long", f"{name}m": "long"}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, at in X.pieces(batches, "text"):
            h1, h2 = (rows.column(rows.schema.get_field_index(f"{name}{i}")).to_numpy() for i in (0, 1))
            n, a, b = cuts(buf, at, h1, h2)
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(keep) + 1)), pa.array(n), pa.array(a), pa.array(b - a)], [*keep, name, *found])

    fields = [f"`{c}` {t}" for c, t in given.drop(f"{name}0", f"{name}1").dtypes] + [f"{c} {t}" for c, t in found.items()]
    out = given.mapInArrow(run, ", ".join(fields))
    plain = (body == "") | body.contains(P) | body.contains(S) | body.contains(M) | (group(F.col(name), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(group(F.col(name), 3) % 100 < spm, "spm").otherwise("psm")
    out = out.withColumn("form", form)
    p, m = F.col(f"{name}p"), F.col(f"{name}m")
    prefix, middle = body.substr(F.lit(1), p.cast("int")), body.substr(p.cast("int") + 1, m.cast("int"))
    suffix = body.substr((p + m).cast("int") + 1, F.char_length(body))
    text = F.when(F.col("form") == "plain", body).when(F.col("form") == "psm", F.concat(F.lit(P), prefix, F.lit(S), suffix, F.lit(M), middle))
    text = text.otherwise(F.concat(F.lit(S), suffix, F.lit(P), prefix, F.lit(M), middle))
    unless = lambda c: F.when(F.col("form") != "plain", c)
    return out.select(*(F.col(f"`{c}`") for c in keep), "n_units", "form", unless(p).alias("prefix_chars"), unless(m).alias("middle_chars"), text.alias("output"))


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that transform() made output from."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
