"""Spelling variants: words one edit apart, found on a relational trie walked level by level.

The words of a dictionary and their reversals form two tries, kept as one
distributed edge table. A state is (word, position, node, edits). A word enters
its own trie without edits at the depth of half its length, since two words one
edit apart share a beginning or an end at least that long; from there its states
meet the edges of one depth after the other in a join. States without an edit go
on along the word's own path and branch off by a replaced, inserted or deleted
letter; states with an edit follow matching letters only. An edge states which
lengths and letters follow below it, so states that cannot end leave at once.
Where at most two words are left below a node, or a word with one edit ends, the
state becomes a pair; pairs are verified on the words themselves.

Nodes and words are known by 64-bit hashes in between. Equal hashes of different
strings would only add pairs, which the verification removes; none is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import scratch_path, written

LETTERS = "A-Za-zÀ-ÿ"       # of a word, as the contract's pattern
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 6, 5, 5
DROP_EVERY = 199
_DEEP = 48                             # depths from here on share a folder of the edge table
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def dictionary(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY,
) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased, of at least ``least_length`` letters and ``least_count`` occurrences.

    A run whose crc32 of ``<doc_id>:<run>`` is a multiple of ``drop_every`` loses
    the letter at that crc modulo its length. NULL texts have no runs; a NULL id
    is written as an empty string. Occurrences are added up before the shuffle.
    """
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(F.col(text), F.lit(f"([{LETTERS}]{{{least_length},}})"), 0)).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    mark = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (mark % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(mark % drop_every == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _entry(length: Column) -> Column:
    """Depth at which a word enters its trie. The common beginning and the common end of two words one edit apart are
    together at least as long as one of them less one letter, so one of the two has half of that or more."""
    return F.floor(length / 2).cast("int")


def _node(side: Column, prefix: Column) -> Column:
    return F.xxhash64(side, prefix)


def _letter(word: Column, position: Column) -> Column:
    """The code of the letter at ``position`` (from 0); 0 behind the end."""
    return F.ascii(F.substring(word, position + 1, F.lit(1)))


def _bit(n: Column) -> Column:
    """A BIGINT with bit ``n`` set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), n.cast("int"))


def _letter_bit(code: Column) -> Column:
    return F.when(code == 0, F.lit(0).cast("bigint")).otherwise(_bit(code % 64))


def _left_bit(left: Column) -> Column:
    """The bit that stands for a number of letters left; 63 stands for any larger one too."""
    return _bit(F.least(left, F.lit(63)))


def _has(mask: str, bit: Column) -> Column:
    return F.col(mask).bitwiseAND(bit) != 0


def sides(words: DataFrame) -> DataFrame:
    """id, side, w: each word as read from its beginning (side 0) and from its end (side 1), with its hash."""
    forms = F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("w")),
                    F.struct(F.lit(1).alias("side"), F.reverse("word").alias("w")))
    return words.select(F.xxhash64("word").alias("id"), F.inline(forms).alias("side", "w"))


def edge_table(read: DataFrame) -> DataFrame:
    """The tries as edges: depth, parent, letter, node and facts of the node; stored, one folder a depth.

    ``below`` words pass the node or end there, ``ends`` has the bits of their
    numbers of letters left, ``follows`` those of their next letters, ``least``
    and ``most`` are the extremes of their hashes, ``own`` is the hash of the word
    that ends there. A word has edges from its entry depth on, less one for the
    words that are shorter by a letter.
    """
    n, w, depth = F.length("w"), F.col("w"), F.col("depth")
    first = F.greatest(F.lit(1), _entry(n - 1))
    rows = read.select("id", "side", "w", F.explode(F.sequence(first, n)).alias("depth")).select(
        "depth", "id", _node(F.col("side"), F.substring(w, F.lit(1), depth - 1)).alias("parent"),
        _letter(w, depth - 1).alias("letter"), _node(F.col("side"), F.substring(w, F.lit(1), depth)).alias("node"),
        _left_bit(n - depth).alias("end"), _letter_bit(_letter(w, depth)).alias("next"), (n == depth).alias("ended"))
    grouped = rows.groupBy("depth", "parent", "letter", "node").agg(
        F.count("*").alias("below"), F.bit_or("end").alias("ends"), F.bit_or("next").alias("follows"),
        F.min("id").alias("least"), F.max("id").alias("most"), F.max(F.when(F.col("ended"), F.col("id"))).alias("own"))
    stored = grouped.withColumn("folder", F.least("depth", F.lit(_DEEP)))
    path = scratch_path(read.sparkSession, "trie")
    stored.write.partitionBy("folder").parquet(path)
    return read.sparkSession.read.schema(stored.schema).parquet(path)


def _at_depth(edges: DataFrame, depth: int) -> DataFrame:
    return edges.where((F.col("folder") == min(depth, _DEEP)) & (F.col("depth") == depth))


def _arrived(states: DataFrame) -> DataFrame:
    """id, side, w, node, at, edits, pairs of states that reached a node whose facts stand beside them.

    States that cannot end below are left out. ``pairs`` holds hashes of words
    where the walk ends: the last two below the node, or the word that ends
    there. Of the others, those without an edit also go on with a letter deleted.
    """
    w, at = F.col("w"), F.col("at")
    left = F.length("w") - at
    none = F.array().cast("array<bigint>")

    def reaches(left: Column) -> Column:
        return (left >= 0) & _has("ends", _left_bit(F.greatest(left, F.lit(0))))

    def one_edit(left: Column, at: Column) -> Column:
        return reaches(left) & ((left == 0) | _has("follows", _letter_bit(_letter(w, at))))

    exact = F.col("edits") == 0
    few = F.col("below") <= 2
    last = F.array("own")
    kept = states.where(F.when(exact, reaches(left - 1) | reaches(left) | reaches(left + 1)).otherwise(one_edit(left, at)))
    here = F.struct(at.alias("at"), F.col("edits").alias("edits"), F.when(
        few, F.array_distinct(F.array("least", "most"))).when(~exact & (left == 0), last).otherwise(none).alias("pairs"))
    shorter = F.struct((at + 1).alias("at"), F.lit(1).alias("edits"), F.when(left == 1, last).otherwise(none).alias("pairs"))
    deletes = exact & ~few & one_edit(left - 1, at + 1)
    return kept.select("id", "side", "w", "node", F.inline(
        F.when(deletes, F.array(here, shorter)).otherwise(F.array(here))).alias("at", "edits", "pairs"))


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states after one more edge: along the same letter, or with a first edit, a letter replaced or inserted."""
    s = states.where(F.size("pairs") == 0).select(
        "id", "side", "w", "at", "edits", F.col("node").alias("from"), _letter(F.col("w"), F.col("at")).alias("wanted"))
    same = F.col("letter") == F.col("wanted")
    met = s.join(edges, (F.col("from") == F.col("parent")) & (same | (F.col("edits") == 0)))
    on = F.struct((F.col("at") + 1).alias("at"), F.col("edits").alias("edits"))
    replaced = F.struct((F.col("at") + 1).alias("at"), F.lit(1).alias("edits"))
    inserted = F.struct(F.col("at").alias("at"), F.lit(1).alias("edits"))
    moves = F.when(same, F.array(on)).when(F.col("wanted") == 0, F.array(inserted)).otherwise(F.array(replaced, inserted))
    return _arrived(met.select("id", "side", "w", "node", "below", "ends", "follows", "least", "most", "own",
                               F.inline(moves).alias("at", "edits")))


def neighbours(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: every ordered pair of words exactly one inserted, deleted or replaced letter apart.

    ``words`` (word, n) are distinct, of at least two letters, and stored.
    """
    spark = words.sparkSession
    read = written(sides(words), "sides")
    edges = edge_table(read)
    entering = read.withColumn("enters", _entry(F.length("w")))
    entered = entering.join(
        edges.select("depth", "node", "below", "ends", "follows", "least", "most", "own"),
        (F.col("enters") == F.col("depth")) & (F.col("node") == _node(F.col("side"), F.substring(F.col("w"), F.lit(1), F.col("enters")))))
    facts = ["node", "below", "ends", "follows", "least", "most", "own"]
    entered = entered.select("id", "side", "w", F.col("depth").alias("at"), F.lit(0).alias("edits"), *facts)
    # a state that has just entered stands at the depth of its node; one with a deleted letter is a letter ahead
    start = written(_arrived(entered).withColumn("depth", F.col("at") - F.col("edits")), "entered")
    depths = sorted(r.depth for r in start.where(F.size("pairs") == 0).select("depth").distinct().collect())
    found, states, depth = [start.select("id", "pairs")], None, 0
    while depths or states is not None:
        if states is None:
            depth = depths[0]
        if depths and depths[0] == depth:
            depths.pop(0)
            fresh_states = start.where(F.col("depth") == depth).drop("depth")
            states = fresh_states if states is None else states.unionByName(fresh_states)
        states = written(_step(states, _at_depth(edges, depth + 1)), "states")
        found.append(states.select("id", "pairs"))
        depth += 1
        if states.where(F.size("pairs") == 0).isEmpty():
            states = None
    pairs = reduce(DataFrame.unionByName, found).select("id", F.explode("pairs").alias("other")).where(
        "id <> other").distinct()
    keyed = words.select(F.xxhash64("word").alias("key"), "word", "n")
    both = pairs.join(keyed.withColumnRenamed("key", "id"), "id").join(
        keyed.select(F.col("key").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n")), "other")
    return both.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form: chains of forms followed to their ends, doubling the steps."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("passed"), F.col("root").alias("further"))
        now = written(now.join(ahead, F.col("root") == F.col("passed"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def group_variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row per word of ``words`` (word, n; distinct).

    ``form`` is the near word of largest n (ties: smallest in code-point order)
    if that n is at least ``factor`` times the word's, else NULL; ``root`` is the
    end of the chain of forms, the word itself where it has none. Counts grow along
    a chain, so it ends. Rows with a NULL word are left out; no words, no rows.
    """
    words = written(words.where("word IS NOT NULL").select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    per_word = neighbours(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.n") >= factor * F.col("n")
    rows = written(words.join(per_word, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "variants")
    roots = _roots(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The variants of all words of ``docs``: see ``dictionary`` and ``group_variants``.

    NULL and empty texts add nothing, repeated rows count as often as they stand
    there, other columns are not read, an empty table gives an empty result. Work
    takes one join per letter of the longest word that shares half its letters
    with two others.
    """
    return group_variants(dictionary(docs, doc_id, text))
