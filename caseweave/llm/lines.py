"""Line deduplication with a log-template tree.

Lines are parsed by a tree of fixed depth: first their token count, then their leading tokens, where tokens with
digits are variable.  A leaf holds several templates.  Each list of tokens that many documents have is one of its own
(digits hidden if at least half of the tokens are constant, else verbatim); so is each half of such a list, if it is
constant and of at least five tokens.  What remains of a leaf that many documents reach gives one more: a position
whose most common token has at least half of those lines is constant, and lines follow it that agree with constants
on at least half of the positions after the leading ones.  Templates that recur across unlike documents are dropped.

Documents are told apart by their own lines: those that follow no candidate template, and do not begin or end like a
line that does (an edited copy of it).  Documents of equal sets of own lines count once, and those of none count as
one, so that the lines of a document's exact or slightly edited copies do not pass for recurring ones.  A template
recurs if `support` different sets have it, however many copies each has and however many texts there are.

The tree is walked by vectorised kernels over whole Arrow slices, which give a few numbers a line.  Texts are not
shuffled: what a line is known by is looked up in the keys of the candidates, which are broadcast; only where there
are more of them than BROADCAST_KEYS, texts are joined with their line numbers instead; the lines are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import _text
from ._store import ready, remove, written

#: Leading tokens of the tree, fewest tokens of a line, different documents of a template, share of equal tokens.
DEPTH, TOKENS, SUPPORT, AGREE = 3, 2, 8, 0.5
#: Tokens of a constant half that is a template: as many as a shingle has, for shorter runs of words recur in ordinary text.
HALF = 5
#: Keys and numbers of templates that are broadcast, 16 MB.
BROADCAST_KEYS = 2_000_000

_VARIABLE = np.uint64(0x2545F4914F6CDD1D)
_VAR = int(_VARIABLE.view(np.int64))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _named(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, th (hash of the text) and text of the rows that have one."""
    ready(rows.sparkSession)
    return rows.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).filter("text is not null")


#: What a line is known by: its leaf, its list of tokens, the list's halves, its first and its last words; 0 for none.
KEYS = ("leaf", "pat", "half1", "half2", "head", "tail")


def _tree(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, number, first word, words, KEYS) of every line that is not blank."""
    n = len(offsets) - 1
    words = _text.split(data, offsets, lower=False)
    breaks = np.flatnonzero(data == 10)
    owner = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, owner))  # an empty text may begin where another ends
    owner, starts = owner[order], starts[order]
    last = np.append(owner[1:] != owner[:-1], True)
    ends = np.append(starts[1:] - 1, 0)
    ends[last] = offsets[1:]
    first = np.searchsorted(owner, np.arange(n))  # each text's first line
    no = np.arange(len(starts)) - first[owner]
    # Words by line, and the words' hashes with digits hidden.
    a, z = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    full = np.flatnonzero(z > a)
    owner, no, a, z = owner[full], no[full], a[full], z[full]
    count = z - a
    hashes = words.hashes()
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    variable = digits[words.ends] > digits[words.starts]
    masked = np.where(variable, _VARIABLE, hashes)
    # Sums over places of a line, so that any run of its words has a hash.
    step = np.uint64(0x9E3779B97F4A7C15)
    at, back = (np.arange(len(hashes)) - np.repeat(a, count)).astype(np.uint64), (np.repeat(z, count) - np.arange(len(hashes))).astype(np.uint64)
    summed = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(_text.mix64(x), dtype=np.uint64)])
    hidden, plain, from_end = summed(masked + (at + np.uint64(1)) * step), summed(hashes + (at + np.uint64(1)) * step), summed(hashes + back * step)
    fixed = np.concatenate([[0], np.cumsum(~variable)])
    size = count.astype(np.uint64)
    key = lambda salt, x: _text.mix64(x + size * step + np.uint64(salt))
    deep = count > DEPTH
    lead = np.minimum(DEPTH, count)
    leaf = key(1, hidden[a + lead] - hidden[a])
    open_ = (fixed[z] - fixed[a]) >= count * AGREE
    pat = np.where(open_, key(2, hidden[z] - hidden[a]), key(3, plain[z] - plain[a]))
    half = (count + 1) // 2
    long = half >= HALF
    half1 = np.where(long & (fixed[a + half] - fixed[a] == half), key(4, hidden[a + half] - hidden[a]), np.uint64(0))
    half2 = np.where(long & (fixed[z] - fixed[z - half] == half), key(5, _text.mix64(leaf) + hidden[z] - hidden[z - half]), np.uint64(0))
    few = np.where(count >= 6, 3, np.minimum(2, count))
    some, width = count >= 4, few.astype(np.uint64) * step
    head = np.where(some, _text.mix64(plain[a + few] - plain[a] + width + np.uint64(6)), np.uint64(0))
    tail = np.where(some, _text.mix64(from_end[z] - from_end[z - few] + width + np.uint64(7)), np.uint64(0))
    return owner, no, a, count, np.where(deep, leaf, np.uint64(0)), pat, half1, half2, head, tail


def _parsed(rows: DataFrame) -> DataFrame:
    """th, no, n and KEYS of every line that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data, offsets in _text.slices(batch, "text"):
                owner, no, _, count, *keys = _tree(data, offsets)
                columns = [own.column(1).take(pa.array(owner)), pa.array(no.astype(np.int32)), pa.array(count.astype(np.int32)), *[pa.array(k.view(np.int64)) for k in keys]]
                yield pa.RecordBatch.from_arrays(columns, ["th", "no", "n", *KEYS])

    return rows.mapInArrow(run, "th long, no int, n int, " + ", ".join(f"{k} long" for k in KEYS))


def _masked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of each word of a slice, variable ones alike."""
    words = _text.split(data, offsets, lower=False)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    return np.where(digits[words.ends] > digits[words.starts], _VARIABLE, words.hashes())


def _isin(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of x is among the sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _keys(df: DataFrame, column: str) -> np.ndarray | None:
    """The sorted keys of a written table, null where they are too many to broadcast."""
    if df.count() > BROADCAST_KEYS:
        return None
    return np.sort(df.select(column).toArrow()[column].to_numpy().view(np.uint64))


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _tokens(rows: DataFrame, rest: DataFrame, listed: DataFrame, leaves: DataFrame) -> DataFrame:
    """th, no, leaf, n, tokens (hashes, variable ones alike) of the lines of rest (th, no, leaf) in these leaves."""
    known, open_ = _keys(listed, "key"), _keys(leaves, "leaf")
    share = None
    if known is None or open_ is None:
        nos = rest.join(leaves, "leaf", "left_semi").groupBy(F.col("th").alias("__th")).agg(F.collect_set("no").alias("nos"))
        texts = rows.join(nos, F.col("th") == F.col("__th")).select("th", "text", "nos")
    else:
        share = rows.sparkSession.sparkContext.broadcast((known, open_))
        texts = rows.select("th", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data, offsets in _text.slices(batch, "text"):
                owner, no, a, count, leaf, pat, half1, half2, *_ = _tree(data, offsets)
                if share is not None:
                    listed, leaves = share.value
                    at = np.flatnonzero(_isin(leaf, leaves) & ~(_isin(pat, listed) | _isin(half1, listed) | _isin(half2, listed)))
                else:
                    wanted = [set(x) for x in own.column(2).to_pylist()]
                    at = np.array([k for k, (t, i) in enumerate(zip(owner.tolist(), no.tolist(), strict=True)) if leaf[k] and i in wanted[t]], np.int64)
                edges = np.concatenate([[0], np.cumsum(count[at])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(_masked(data, offsets)[_text.ranges(a[at], count[at])].view(np.int64)))
                columns = [own.column(0).take(pa.array(owner[at])), pa.array(no[at].astype(np.int32)), pa.array(leaf[at].view(np.int64)), pa.array(count[at].astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["th", "no", "leaf", "n", "tokens"])

    return texts.mapInArrow(run, "th long, no int, leaf long, n int, tokens array<long>")


def _common(keyed: DataFrame, support: int) -> DataFrame:
    """The keys of (key, th) that enough different texts have."""
    # Uses bound texts from above, and are summed before the shuffle.
    many = _small(written(keyed.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= support).select("key"), "lines-many"))
    per = keyed.join(many, "key", "left_semi").groupBy("key", "th").agg(F.lit(1).alias("one"))
    return per.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= support).select("key")


def _agreeing(tokens: str, template: str):
    """Constants of the template that a line's tokens have, after the leading ones."""
    after = lambda c: F.slice(c, DEPTH + 1, F.greatest(F.size(c) - DEPTH, F.lit(0)))
    hit = F.zip_with(after(tokens), after(template), lambda t, m: F.when((t == m) & (m != _VAR), 1).otherwise(0))
    return F.aggregate(hit, F.lit(0), lambda a, x: a + x)


def _follows(rows: DataFrame, found: DataFrame, support: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(th, no, key of the lines that follow a candidate, the listed keys, leaf and template of the leaves that have one)."""
    lists = F.explode(F.array("pat", "half1", "half2")).alias("key")
    deep = found.filter(F.col("n") >= TOKENS)
    keyed = deep.select("th", "no", lists).filter("key <> 0")
    keys = written(_common(keyed.select("key", "th"), support), "lines-keys")
    listed = written(keyed.join(_small(keys), "key", "left_semi").select("th", "no", "key"), "lines-listed")
    rest = deep.filter("leaf <> 0").select("th", "no", "leaf").join(listed.select("th", "no"), ["th", "no"], "left_anti")
    rest = written(rest, "lines-rest")
    leaves = written(_common(rest.select(F.col("leaf").alias("key"), "th"), support).withColumnRenamed("key", "leaf"), "lines-leaves")
    held = written(_tokens(rows, rest, keys, leaves), "lines-held")
    cells = held.select("leaf", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count("*").alias("c"))
    modes = cells.groupBy("leaf", "at").agg(F.max_by("token", F.struct("c", "token")).alias("token"), F.max("c").alias("most"), F.sum("c").alias("all"))
    modes = modes.select("leaf", "at", F.when(F.col("most") * 2 >= F.col("all"), F.col("token")).otherwise(_VAR).alias("token"))
    # A leaf's lines have equal token counts, so a template is as long as one line.
    made = modes.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("template"))
    made = written(made, "lines-made")
    follow = held.join(_small(made), "leaf").filter(_agreeing("tokens", "template") >= (F.col("n") - DEPTH) * F.lit(AGREE)).select("th", "no", F.col("leaf").alias("key"))
    return listed.unionByName(follow), keys, made


def _recurring(found: DataFrame, follow: DataFrame, support: int) -> DataFrame:
    """Keys that documents of enough different sets of own lines follow."""
    lines = follow.select("th", "no").distinct()
    inside = found.join(lines.select("th").distinct(), "th", "left_semi")
    cues = lambda df: df.select(F.explode(F.array("head", "tail")).alias("cue")).filter("cue <> 0").distinct()
    seen = _small(written(cues(inside.join(lines, ["th", "no"], "left_semi")), "lines-cues"))
    other = inside.join(lines, ["th", "no"], "left_anti").select("th", "pat", "head", "tail")
    for c in ("head", "tail"):
        other = other.join(seen.withColumnRenamed("cue", c), c, "left_anti")
    own = other.select("th", "pat").distinct().groupBy("th").agg(F.bit_xor(F.xxhash64("pat")).alias("own"))
    per = follow.select("key", "th").distinct().join(own, "th", "left").groupBy("key", F.coalesce("own", F.lit(0)).alias("own")).agg(F.lit(1).alias("one"))
    return per.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") >= support).select("key")


def _gone(rows: DataFrame, support: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(th, no, key of the lines that go, recurring keys, listed keys, leaf and template)."""
    found = written(_parsed(rows), "lines-parsed")
    follow, keys, made = _follows(rows, found, support)
    follow = written(follow, "lines-follow")
    recurring = written(_recurring(found, follow, support), "lines-recurring")
    remove(found)
    return follow.join(_small(recurring), "key", "left_semi"), recurring, keys, made


def templates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT) -> DataFrame:
    """Lines that follow a recurring template: doc_id, th, no, template (variable fields as <*>)."""
    rows = _named(docs, doc_id, text)
    gone, _, _, made = _gone(rows, support)
    gone = gone.join(made, gone["key"] == made["leaf"], "left").groupBy("th", "no").agg(F.max("template").alias("template"))
    parts = F.filter(F.split(F.get(F.split("text", "\n"), F.col("no")), "[ \t-\r]+"), lambda x: x != "")
    varies = lambda x, i: x.rlike("[0-9]") | F.coalesce((i >= DEPTH) & (F.get("template", i) == _VAR), F.lit(False))
    hidden = F.array_join(F.transform(parts, lambda x, i: F.when(varies(x, i), "<*>").otherwise(x)), " ")
    return rows.join(gone, "th").select("doc_id", "th", "no", hidden.alias("template"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT) -> DataFrame:
    """The rows of docs, their text without lines of recurring templates, and n_lines and n_removed.

    A null text stays null with 0 lines; lines of one word are kept (brackets, rules and headings stand in ordinary
    documents); repeated rows lose the same lines; a null doc_id counts as one document; an empty table gives an empty
    result.  The other columns stay as they are, also columns named like this operator's own, which the counts n_lines
    and n_removed replace.
    """
    gone, recurring, listed, made = _gone(_named(docs, doc_id, text), support)
    docs = docs.drop("n_lines", "n_removed")
    sets = [_keys(recurring, "key"), _keys(listed, "key"), _keys(made, "leaf")]
    if any(x is None for x in sets) or made.agg(F.coalesce(F.sum(F.size("template")), F.lit(0))).first()[0] > BROADCAST_KEYS:
        return _joined(docs, gone, text)
    table = made.join(F.broadcast(recurring), made["leaf"] == recurring["key"], "left_semi").toArrow()
    leaf = table["leaf"].to_numpy().view(np.uint64)
    order = np.argsort(leaf)
    plans = table["template"].combine_chunks().take(pa.array(order))
    sizes = np.asarray(plans.value_lengths()).astype(np.int64)
    share = docs.sparkSession.sparkContext.broadcast((sets[0], sets[1], leaf[order], np.cumsum(sizes) - sizes, np.asarray(plans.flatten()).view(np.uint64)))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recurring, listed, leaves, begin, plan = share.value
        for batch in batches:
            for own, data, offsets in _text.slices(batch, text):
                owner, no, first, count, leaf, pat, half1, half2, *_ = _tree(data, offsets)
                deep = count >= TOKENS
                of = lambda keys: deep & (_isin(pat, keys) | _isin(half1, keys) | _isin(half2, keys))  # noqa: B023,E731
                out = of(recurring)
                near = np.flatnonzero(_isin(leaf, leaves) & ~of(listed))
                if len(near):
                    tokens, n = _masked(data, offsets), count[near] - DEPTH
                    mine = tokens[_text.ranges(first[near] + DEPTH, n)]
                    theirs = plan[_text.ranges(begin[np.searchsorted(leaves, leaf[near])] + DEPTH, n)]
                    agree = np.bincount(np.repeat(np.arange(len(near)), n), (mine == theirs) & (theirs != _VARIABLE), len(near))
                    out[near] |= agree >= n * AGREE
                removed = np.bincount(owner[out], minlength=len(own))
                column = own.column(at)
                n_lines = np.bincount(np.searchsorted(offsets, np.flatnonzero(data == 10), "right") - 1, minlength=len(own)) + 1
                n_lines[np.asarray(column.is_null())] = 0
                if out.any():
                    numbers = np.split(no[out], np.cumsum(removed)[:-1])
                    texts = column.to_pylist()
                    for k in np.flatnonzero(removed).tolist():
                        drop = set(numbers[k].tolist())
                        texts[k] = "\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in drop)
                    column = pa.array(texts, column.type)
                columns = [*own.columns[:at], column, *own.columns[at + 1 :], pa.array(n_lines.astype(np.int64)), pa.array(removed.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [*own.schema.names, "n_lines", "n_removed"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_removed", LongType())]))


def _joined(docs: DataFrame, gone: DataFrame, text: str) -> DataFrame:
    """deduplicate() by a join of texts with the numbers of their lines that go, for any number of templates."""
    gone = written(gone.groupBy("th").agg(F.collect_set("no").alias("nos")), "lines-gone")
    rows = docs.join(gone, F.xxhash64(docs[text]) == gone["th"], "left")
    parts = F.split(docs[text], "\n")
    n_lines = F.length(docs[text]) - F.length(F.replace(docs[text], F.lit("\n"), F.lit(""))) + 1
    kept = F.filter(parts, lambda x, i: ~F.array_contains(gone["nos"], i))
    cut = F.when(gone["nos"].isNull(), docs[text]).otherwise(F.array_join(kept, "\n"))
    others = [docs[c] if c != text else cut.alias(text) for c in docs.columns]
    return rows.select(*others, F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone["nos"]), F.lit(0)).cast("long").alias("n_removed"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = deduplicate(docs)
    return cut.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), "n_removed", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))

