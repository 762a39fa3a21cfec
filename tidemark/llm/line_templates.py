"""Line deduplication by a fixed-depth tree of log templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

WILD = "<*>"
DEPTH = 3
MIN_TOKENS = 3
MIN_DOCS = 10
LONG_TOKENS = 50
LONG_DOCS = 2
SIMILARITY = 0.7


_UNTIDY = ("\t", "\r", "\x0b", "\f", "  ", " \n", "\n ")
_VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def masked_lines(text: Column) -> Column:
    """Lines with single blanks between tokens, and each token with a digit made a variable.

    Whole texts are rewritten only where a blank is out of place, lines only where they have a digit.
    """
    text = F.coalesce(text, F.lit(""))
    blanks = F.regexp_replace(text, r"[ \t\r\x0B\f]+", " ")
    edges = F.replace(F.replace(blanks, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    untidy = reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in _UNTIDY], text.startswith(" ") | text.endswith(" "))
    lines = F.split(F.when(untidy, F.trim(edges)).otherwise(text), "\n")
    return F.transform(
        lines, lambda line: F.when(line.rlike("[0-9]"), F.regexp_replace(line, _VARIABLE, WILD)).otherwise(line)
    )


def _tokens(line: Column) -> Column:
    return F.split(line, " ")


def _lead(line: Column) -> Column:
    return F.substring_index(line, " ", DEPTH)


def _size(line: Column) -> Column:
    """Tokens have single blanks between them."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _leaf(line: Column, min_tokens: int) -> Column:
    """A hash of the place in the tree, null for empty lines and those of fewer than
    ``min_tokens`` tokens. Lines shorter than the tree is deep are their own lead."""
    size = _size(line)
    return F.when((line != "") & (size >= min_tokens), F.xxhash64(size, _lead(line)))


def _located(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.xxhash64(docs[text_col], F.length(docs[text_col])).alias("text"),
        masked_lines(docs[text_col]).alias("lines"),
    )


def line_places(
    docs: DataFrame, text_col: str = "text", min_tokens: int = MIN_TOKENS, long_tokens: int = LONG_TOKENS
) -> DataFrame:
    """(file, row, at, hash, length, leaf, text, long) of every line, written: a narrow table.

    ``text`` is a hash of the whole text, ``long`` tells lines of over ``long_tokens`` tokens.
    """
    lines = _located(docs, text_col).select("file", "row", "text", F.posexplode("lines").alias("at", "line"))
    return written(
        lines.select(
            "file", "row", "at", F.xxhash64("line").alias("hash"), F.length("line").alias("length"),
            _leaf(F.col("line"), min_tokens).alias("leaf"),
            "text", (_size(F.col("line")) > long_tokens).alias("long"),
        ),
        "line-places",
    )


def _votes(pool: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(part, at, token, votes) of the tokens that can decide anything, and a row per part
    of at least ``min_docs`` votes: its template, and the position to split it at."""
    tokens = written(
        pool.select("part", "line_docs", F.posexplode(_tokens(F.col("line"))).alias("at", "token"))
        .groupBy("part", "at", "token")
        .agg(F.sum("line_docs").alias("votes"))
        # Half of a part's votes, or ``min_docs`` of them.
        .where(F.col("votes") * 2 >= min_docs),
        "token-votes",
    )
    totals = (
        pool.groupBy("part")
        .agg(F.sum("line_docs").alias("total"), F.first(_size(F.col("line"))).alias("size"))
        .where(F.col("total") >= min_docs)
    )
    tops = tokens.groupBy("part", "at").agg(F.min(F.struct((-F.col("votes")).alias("order"), "token")).alias("top"))
    votes = -F.col("top.order")
    frequent = F.when(votes * 2 >= F.col("total"), F.struct("at", "top.token"))
    divides = F.when((votes < F.col("total")) & (votes >= min_docs), F.struct(votes.alias("votes"), (-F.col("at")).alias("order")))
    parts = (
        tops.join(totals, "part")
        .groupBy("part")
        .agg(F.first("size").alias("size"), F.collect_list(frequent).alias("known"), F.max(divides).alias("split"))
        .withColumn("known", F.map_from_entries("known"))
        .select(
            "part",
            F.transform(
                F.sequence(F.lit(0), F.col("size") - 1), lambda at: F.coalesce(F.col("known")[at], F.lit(WILD))
            ).alias("common"),
            (-F.col("split.order")).alias("at"),
        )
    )
    return tokens, parts


def _fits(line: Column, common: Column, similarity: float) -> Column:
    """Whether a line belongs to a template of its leaf.

    At least half of the template is constant, and ``similarity`` of the constants after
    the leading tokens agree; those before agree in every line of the leaf and tell
    nothing. A line of which ``similarity`` of all positions agree belongs to it anyway.
    """
    size = F.size(common)
    pairs = F.zip_with(_tokens(line), common, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    fixed = F.filter(pairs, lambda p: p["b"] != WILD)
    after = F.filter(F.slice(pairs, DEPTH + 1, F.greatest(size - DEPTH, F.lit(0))), lambda p: p["b"] != WILD)
    agree = lambda some: F.size(F.filter(some, lambda p: p["a"] == p["b"]))
    generalised = (F.size(fixed) * 2 >= size) & (F.size(after) > 0) & (agree(after) >= similarity * F.size(after))
    return (agree(pairs) >= similarity * size) | generalised


def line_templates(
    docs: DataFrame,
    places: DataFrame,
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    similarity: float = SIMILARITY,
    min_tokens: int = MIN_TOKENS,
) -> DataFrame:
    """(line, template, line_docs): masked lines with the template they belong to, and in
    how many different texts they stand, as exact copies of a document are one text.

    Lines come to a leaf by token count and leading tokens; leaves with fewer than
    ``min_docs`` lines cannot recur and are left out, as are empty lines and those of fewer than
    ``min_tokens`` tokens. Equal lines are counted before anything is done by leaf.

    A leaf has as many templates as recur in it. In each round the lines of a part (at
    first a leaf) vote: the template has at each position the token of most documents if
    at least half of them have it, else a variable; of equally frequent tokens the first by
    name. The lines that fit it (``_fits``) take it if they stand in ``min_docs``
    documents or more. The others are divided by their token at the position whose most
    frequent token has most votes without being in every line, tokens below ``min_docs``
    together, and vote again, until no token divides a part. Each round makes a position
    the same in a whole part or leaves it without a recurring token, so rounds end.
    A line without such a template is a template of its own.
    """
    busy = written(
        places.where("leaf is not null").groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"),
        "busy-leaves",
    )
    lines = _located(docs, text_col).select("text", F.explode(F.array_distinct("lines")).alias("line"))
    leaves = written(
        lines.withColumn("leaf", _leaf(F.col("line"), min_tokens))
        .join(busy, "leaf", "left_semi")
        .groupBy("line", "text").agg(F.lit(1).alias("one"))
        .groupBy("line").agg(F.count("*").alias("line_docs"))
        .select(_leaf(F.col("line"), min_tokens).alias("part"), "line", "line_docs"),
        "lines",
    )
    found, pool = None, leaves
    while not pool.isEmpty():
        tokens, parts = _votes(pool, min_docs)
        judged = written(
            pool.join(parts, "part").select(
                "part", "line", "line_docs", "at",
                F.when(_fits(F.col("line"), F.col("common"), similarity), F.array_join("common", " ")).alias("template"),
                F.try_element_at(_tokens(F.col("line")), (F.col("at") + 1).cast("int")).alias("token"),
            ),
            "judged-lines",
        )
        taken = (
            judged.where("template is not null").groupBy("part").agg(F.sum("line_docs").alias("docs"))
            .where(F.col("docs") >= min_docs).select("part")
        )
        taken = written(taken, "taken-parts")
        fitted = judged.where("template is not null").join(taken, "part", "left_semi")
        found = fitted if found is None else found.unionByName(fitted)
        rest = judged.join(taken.withColumn("_taken", F.lit(True)), "part", "left").where(
            F.col("at").isNotNull() & (F.col("_taken").isNull() | F.col("template").isNull())
        )
        known = tokens.where(F.col("votes") >= min_docs).select("part", "at", "token", F.lit(True).alias("_known"))
        pool = written(
            rest.join(known, ["part", "at", "token"], "left").select(
                F.xxhash64("part", "at", F.when(F.col("_known"), F.col("token"))).alias("part"), "line", "line_docs"
            ),
            "line-pool",
        )
    alone = leaves.select("line", F.col("line").alias("template"), "line_docs")
    if found is None:
        return alone
    found = found.select("line", "template", "line_docs")
    return found.unionByName(alone.join(found.select("line"), "line", "left_anti"))


def drop_recurring_lines(
    docs: DataFrame,
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    similarity: float = SIMILARITY,
    long_docs: int = LONG_DOCS,
    min_tokens: int = MIN_TOKENS,
    long_tokens: int = LONG_TOKENS,
) -> DataFrame:
    """The documents without the lines whose template occurs in ``min_docs`` different texts or more,
    and without the lines of over ``long_tokens`` tokens that, masked, stand in ``long_docs``
    different texts or more. Lines of fewer than ``min_tokens`` tokens stay; with 1 all lines
    but empty ones count.

    ``docs`` reads files. Adds ``n_lines`` and ``n_dropped``; the text keeps its
    other lines, unmasked. A template's texts are counted once each, however many of
    its lines they hold and however many documents are copies of them, so copies do not empty each other. Null texts stay null and have no lines, an empty text has one
    empty line; rows are told apart by their place in the files, so null and repeated
    ids do no harm; other columns are kept, those of the added names replaced; an empty
    table gives no rows.
    """
    places = line_places(docs, text_col, min_tokens, long_tokens)
    kinds = written(
        line_templates(docs, places, text_col, min_docs, similarity, min_tokens).select(
            F.xxhash64("line").alias("hash"), F.length("line").alias("length"),
            F.xxhash64("template").alias("template"), "line_docs",
        ),
        "line-kinds",
    )
    often = kinds.groupBy("template").agg(F.sum("line_docs").alias("most")).where(F.col("most") >= min_docs)
    candidates = written(kinds.join(often, "template", "left_semi").select("hash", "length", "template"), "candidates")
    found = written(
        places.join(candidates, ["hash", "length"]).select("file", "row", "at", "template", "text"), "template-places"
    )
    recurring = (
        found.groupBy("template", "text").agg(F.lit(1).alias("one"))
        .groupBy("template").agg(F.count("*").alias("texts"))
        .where(F.col("texts") >= min_docs)
    )
    long_lines = places.where("long")
    passages = (
        long_lines.groupBy("hash", "length", "text").agg(F.lit(1).alias("one"))
        .groupBy("hash", "length").agg(F.count("*").alias("texts"))
        .where(F.col("texts") >= long_docs)
    )
    repeated = long_lines.join(written(passages.select("hash", "length"), "passages"), ["hash", "length"], "left_semi")
    gone = (
        found.join(written(recurring.select("template"), "recurring"), "template", "left_semi")
        .select("file", "row", "at")
        .unionByName(repeated.select("file", "row", "at"))
        .groupBy("file", "row")
        .agg(F.collect_set("at").alias("_gone"))
    )
    whole = docs.select(
        F.struct(*docs.columns).alias("_doc"),
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    before = F.col(f"_doc.`{text_col}`")
    lines = F.split(before, "\n")
    kept = F.filter(
        F.transform(lines, lambda line, k: F.struct(line.alias("line"), k.alias("at"))),
        lambda x: ~F.array_contains(F.col("_gone"), x["at"]),
    )
    text = F.when(F.col("_gone").isNull(), before).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    # Documents with such lines grow with the input, so they are never broadcast.
    return whole.join(gone.hint("merge"), ["file", "row"], "left").select(
        *[
            text.alias(c) if c == text_col else F.col(f"_doc.`{c}`")
            for c in docs.columns
            if c not in ("n_lines", "n_dropped")
        ],
        F.when(before.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_dropped"),
    )
