"""Resolving ids, titles and references: equi-joins first, and blocked joins where the test is not an equality."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import text as T
from quire.plans.materialize import written
from quire.plans.session import small_batches


def union_matches(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def resolve_ids(queries: DataFrame, ids: DataFrame, titles: DataFrame) -> DataFrame:
    """queries(q) against ids(value, work) and, for those without a hit, normalized titles(title, work): one row a query with status FOUND, NOT_FOUND or AMBIGUOUS."""
    direct = queries.join(ids.distinct(), F.col("q") == F.col("value")).groupBy("q").agg(F.collect_set("work").alias("works"))
    rest = queries.join(direct, "q", "left_anti").withColumn("norm", T.normalized_title(F.col("q")))
    by_title = titles.select(T.normalized_title(F.col("title")).alias("norm"), "work").where("norm <> ''").distinct()
    fallback = rest.join(by_title, "norm", "left").groupBy("q").agg(F.collect_set("work").alias("works"))
    both = direct.unionByName(fallback)
    n = F.size("works")
    return both.select("q", F.when(n == 1, F.get("works", F.lit(0))).alias("work"), n.alias("n"), F.when(n == 0, "NOT_FOUND").when(n == 1, "FOUND").otherwise("AMBIGUOUS").alias("status"))


def grams(text: Column, n: int) -> Column:
    """All runs of n words of a blank-separated text: shifted copies of its words, put together position by position."""

    def runs(words: Column) -> Column:
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        out = F.slice(words, F.lit(1), count)
        for k in range(1, n):
            out = F.zip_with(out, F.slice(words, F.lit(k + 1), count), lambda a, b: F.concat_ws(" ", a, b))
        return out

    return T.once(F.split(text, " "), runs)


#: Characters of titles, and titles, that one automaton holds; it is sent to all tasks, at some 100 bytes a character.
AUTOMATON_CHARS, AUTOMATON_TITLES = 400_000, 20_000


def contained_titles(texts: DataFrame, titles: DataFrame, least: int = 24) -> DataFrame:
    """(text_id, title_id): titles of at least `least` characters that stand in a normalized text, also inside words.

    Titles that fit one automaton (AUTOMATON_CHARS and AUTOMATON_TITLES, counted first) are all looked for in one pass over each text, which is
    not moved; more are met by equi-joins on runs of words.
    """
    fitting = written(titles.where(F.length("norm") >= least).select("title_id", "norm").distinct(), "titles")
    chars, n = fitting.agg(F.coalesce(F.sum(F.length("norm")), F.lit(0)), F.count("*")).first()
    if chars > AUTOMATON_CHARS or n > AUTOMATON_TITLES:
        return _contained_by_blocks(texts, fitting)
    known: dict[str, list] = {}
    for r in fitting.collect():  # bounded by AUTOMATON_TITLES
        known.setdefault(r["norm"], []).append(r["title_id"])
    kind = fitting.schema["title_id"].dataType.simpleString()

    @F.pandas_udf(f"array<struct<title_id:{kind},length:int>>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for title in known:
            found.add_word(title, title)
        if known:
            found.make_automaton()
        for s in parts:
            hits = [dict.fromkeys(t for _, t in found.iter(x)) if known and x else () for x in s]
            yield pd.Series([[{"title_id": k, "length": len(t)} for t in some for k in known[t]] for some in hits], dtype=object)

    small_batches(texts.sparkSession)
    met = texts.select("text_id", F.explode(of("norm")).alias("hit"))
    return met.select("text_id", "hit.title_id", "hit.length").distinct()


def _contained_by_blocks(texts: DataFrame, fitting: DataFrame) -> DataFrame:
    """contained_titles for any number of titles, by equi-joins.

    Only a title's first and last word can be cut by a word of the text, so words 2 to 4 of a title of five words or more
    are a run of the text. Such runs are joined, then containment is verified: no text meets all titles. Shorter
    titles are blocked by their longest inner word, and ones of one or two words by equal prefixes of six characters at every place.
    """
    words = F.split("norm", " ")
    fit = fitting.select("title_id", F.col("norm").alias("title"), words.alias("w"), F.size(words).alias("n"))
    text = texts.select("text_id", "norm")

    def places() -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("norm") - 5)), lambda i: F.substring(F.col("norm"), i, F.lit(6)))

    # how a title of so many words is blocked, and the blocks of a text for it
    kinds = (
        (F.col("n") >= 5, F.array_join(F.slice("w", 2, 3), " "), lambda: grams(F.col("norm"), 3)),
        (F.col("n").between(3, 4), F.get("w", F.lit(1)), lambda: words),
        (F.col("n") <= 2, F.substring("title", 1, 6), places),
    )
    has = fit.agg(*[F.count_if(c).alias(f"k{i}") for i, (c, _, _) in enumerate(kinds)]).first()
    met = text.select("text_id", "norm").withColumns({"title_id": F.lit(None).cast(fitting.schema["title_id"].dataType), "title": F.lit(None).cast("string")}).limit(0)
    for i, (c, block, blocks) in enumerate(kinds):
        if has[i]:
            mine = fit.where(c).select("title_id", "title", block.alias("block"))
            # texts are looked up by id once their blocks have met: a text is moved once, not with every block
            pairs = text.select("text_id", F.explode(F.array_distinct(blocks())).alias("block")).join(mine, "block").select("text_id", "title_id", "title").distinct()
            met = met.unionByName(pairs.join(text, "text_id").select("text_id", "norm", "title_id", "title"))
    return met.where(F.contains("norm", "title")).select("text_id", "title_id", F.length("title").alias("length")).distinct()


def resolve_refs_title(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """refs(ref_id, citing, title, raw) x papers(work, title): exact normalized title (0.99), else the longest title of at least 24
    characters within the raw text (0.92); references to the citing paper itself are dropped, without falling through."""
    index = papers.select("work", T.normalized_title(F.col("title")).alias("norm")).where("norm <> ''").groupBy("norm").agg(F.min("work").alias("work"))
    keyed = refs.withColumn("norm", T.normalized_title(F.col("title")))
    exact = keyed.join(index, "norm").select("ref_id", "citing", "work", F.lit(0.99).alias("confidence"))
    rest = keyed.join(exact.select("ref_id"), "ref_id", "left_anti").select(F.col("ref_id").alias("text_id"), "citing", T.normalized_title(F.col("raw")).alias("norm"))
    hits = contained_titles(rest, index.select(F.col("work").alias("title_id"), "norm"))
    best = hits.groupBy("text_id").agg(F.max_by("title_id", F.struct("length", -F.col("title_id"))).alias("work"))
    loose = rest.join(best, "text_id").select(F.col("text_id").alias("ref_id"), "citing", "work", F.lit(0.92).alias("confidence"))
    return exact.unionByName(loose).where("citing <> work")


def resolve_refs_doi(refs: DataFrame, papers: DataFrame) -> DataFrame:
    def key(c: str) -> Column:
        return F.lower(F.trim(F.col(c)))

    return refs.withColumn("k", key("doi")).where("k <> ''").join(papers.select("work", key("paper_doi").alias("k")), "k").drop("k")


#: The longest piece of a title that is looked up.
PIECE = 5


def _pieces(left: DataFrame, right: DataFrame, parts: Column, shift: Column, near: float | None = None) -> DataFrame:
    """left(s) x right(t): a superset of the pairs (s, t) in which fewer than `parts` edits turn s into t, or into a part of t where shift is null.

    s is cut into pieces of one width, at most PIECE and so that there are `parts` of them; an edit touches one piece, so one of any `parts`
    of them stands untouched in t, at most `shift` places away. The ones that t's hold least often are looked up. Both are columns of n,
    the length of s. With `near`, the shorter of a pair has at least this share of the longer's length. A t gives its substrings of
    one width or, where two widths are in use for lengths like its own, of both.
    """
    n = F.length("s")
    known = left.select("s", n.alias("n"), parts(n).alias("parts"), shift(n).alias("shift")).withColumn("width", F.greatest(F.lit(1), F.least(F.lit(PIECE), F.floor(F.col("n") / F.col("parts")))).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.col("n") / F.col("width")).cast("int") - 1)), lambda k: F.struct((k * F.col("width")).alias("at"), F.substring(F.col("s"), k * F.col("width") + 1, F.col("width")).alias("part")))
    pieces = written(known.select("s", "n", "parts", "shift", "width", F.explode(cut).alias("c")).select("s", "n", "parts", "shift", "width", "c.at", "c.part"), "pieces")
    used = [(r["width"], r["lo"], r["hi"]) for r in pieces.groupBy("width").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).collect()]  # at most PIECE rows
    m = F.length("t")
    fits = [F.when((m >= w) & ((m <= hi / near) & (m >= lo * near) if near else F.lit(True)), F.lit(w)) for w, lo, hi in sorted(used)] or [F.lit(None).cast("int")]
    places = right.select("t", F.explode(F.filter(F.array(*fits), lambda w: w.isNotNull())).alias("w"))
    spots = written(places.select("t", F.posexplode(F.transform(F.sequence(F.lit(1), m - F.col("w") + 1), lambda i: F.substring(F.col("t"), i, F.col("w")))).alias("i", "part")), "spots")
    often = spots.groupBy("part").agg(F.count("*").alias("often"))
    turn = F.row_number().over(W.partitionBy("s").orderBy(F.coalesce("often", F.lit(0)), "at"))
    asked = pieces.join(often, "part", "left").withColumn("turn", turn).where((F.col("turn") <= F.col("parts")) & F.col("often").isNotNull())
    return asked.join(spots, "part").where(F.col("shift").isNull() | (F.abs(F.col("i") - F.col("at")) <= F.col("shift"))).select("s", "t").distinct()


def _partial_ratio(a: str, b: str) -> float:
    """100 times the best similarity 1 - indel distance / length of the shorter text to a window of the longer (windows of its length, and shorter ones at both ends)."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    if not n:
        return 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    full, best = (1 << n) - 1, 0.0
    for start in range(1 - n, len(long)):
        window = long[max(0, start) : start + n]
        row = full  # bits of the longest common subsequence, one word operation a character
        for c in window:
            hit = row & masks.get(c, 0)
            row = ((row + hit) | (row - hit)) & full
        best = max(best, 200.0 * (n - row.bit_count()) / (n + len(window)))
    return best


def _partial(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_partial_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return of(a, b)


def resolve_refs_fuzzy(refs: DataFrame, papers: DataFrame, least: float = 85.0, partial: float | None = 95.0) -> DataFrame:
    """refs(ref_id, title) x papers(work, title) -> (ref_id, work, score): for each reference the best paper whose token-sorted Levenshtein
    ratio is at least `least`, else the best whose partial ratio is at least `partial` and whose shorter title is more than half
    of the longer; equal scores go to the least work. Without `partial` the second step is left out.

    Titles are compared once for each distinct form. Of any k + 1 pieces of a form, k edits leave one untouched, so two similar forms share
    one of the k + 1 rarest; these are joined at the places where they can stand. No candidates are lost and nothing is compared with everything.
    """
    share = 1 - least / 100

    def edits(n: Column) -> Column:  # the most edits of a pair whose longer form has n characters
        return F.floor(n * share + 1e-9).cast("int")

    a = refs.select("ref_id", T.token_sorted(F.col("title")).alias("s"), T.normalized_cite(F.col("title")).alias("plain"))
    b = papers.select("work", T.token_sorted(F.col("title")).alias("t")).groupBy("t").agg(F.min("work").alias("work"))
    forms = a.select("s").where("s <> ''").distinct()
    met = _pieces(forms, b.select("t").where("t <> ''"), lambda n: edits(F.ceil(n / (1 - share))) + 1, lambda n: edits(F.ceil(n / (1 - share))), 1 - share)
    met = met.where(F.least(F.length("s"), F.length("t")) >= F.greatest(F.length("s"), F.length("t")) * (1 - share) - 1e-9)
    longest = F.greatest(F.length("s"), F.length("t"))
    scored = met.withColumn("score", F.lit(100.0) * (F.lit(1.0) - F.levenshtein("s", "t") / longest)).where(F.col("score") >= least)
    best = scored.join(b, "t").groupBy("s").agg(F.max_by(F.struct("work", "score"), F.struct("score", -F.col("work"))).alias("m"))
    found = a.join(best, "s").select("ref_id", "m.work", F.round("m.score", 6).alias("score"))
    if partial is None:
        return found
    rest = a.join(found.select("ref_id"), "ref_id", "left_anti").where("plain <> ''").select("ref_id", "plain")
    titles = papers.select("work", T.normalized_cite(F.col("title")).alias("t")).where("t <> ''").groupBy("t").agg(F.min("work").alias("work"))
    texts, gap = rest.select("plain").distinct(), 1 - partial / 100

    def torn(n: Column) -> Column:  # insertions and deletions of a pair of windows of n characters
        return F.floor(2 * n * gap + 1e-9).cast("int")

    anywhere = lambda n: F.lit(None).cast("int")
    # the shorter of two titles has its pieces in the longer
    ours = _pieces(texts.select(F.col("plain").alias("s")), titles.select("t"), lambda n: torn(n) + 1, anywhere).select(F.col("s").alias("plain"), "t")
    theirs = _pieces(titles.select(F.col("t").alias("s")), texts.select(F.col("plain").alias("t")), lambda n: torn(n) + 1, anywhere).select(F.col("t").alias("plain"), F.col("s").alias("t"))
    near = ours.where(F.length("plain") <= F.length("t")).unionByName(theirs.where(F.length("plain") > F.length("t")))
    near = near.where(F.least(F.length("plain"), F.length("t")) * 2 > F.greatest(F.length("plain"), F.length("t")))
    judged = near.withColumn("score", _partial("plain", "t")).where(F.col("score") >= partial)
    second = judged.join(titles, "t").groupBy("plain").agg(F.max_by(F.struct("work", "score"), F.struct("score", -F.col("work"))).alias("m"))
    return found.unionByName(rest.join(second, "plain").select("ref_id", "m.work", F.round("m.score", 6).alias("score")))


def by_rarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(a, words) and right(b, words), words distinct and ids of one type -> (side, id, words): 0 or 1, and the words of each row in the order of how many rows of both hold them."""
    rows = written(left.select(F.lit(0).alias("side"), F.col("a").alias("id"), F.explode("words").alias("word")).unionByName(right.select(F.lit(1).alias("side"), F.col("b").alias("id"), F.explode("words").alias("word"))), "words")
    often = rows.groupBy("word").agg(F.count("*").alias("n"))
    ranked = rows.join(often, "word").groupBy("side", "id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    return written(ranked.select("side", "id", F.transform("w", lambda x: x["word"]).alias("words")), "ranked")


def overlap_pairs(left: DataFrame, right: DataFrame, share: float) -> DataFrame:
    """left(a, words) x right(b, words): (a, b, common, na, nb) of the pairs that have more than `share` of the larger set in common.

    Such pairs share one of the first n - floor(share n) words of each, in one order of all words; the order is by rarity, so
    words that many titles hold are hardly ever joined. The full sets are compared only where such a word is shared.
    """
    ranked, firsts = by_rarity(left, right), []
    n = F.size("words")
    for side, k in enumerate("ab"):
        firsts.append(ranked.where(F.col("side") == side).select(F.col("id").alias(k), F.col("words").alias(f"w{k}"), F.explode(F.slice("words", F.lit(1), n - F.floor(n * share + 1e-9).cast("int"))).alias("word")))
    met = firsts[0].join(firsts[1], "word").drop("word").distinct()
    out = met.select("a", "b", F.size(F.array_intersect("wa", "wb")).alias("common"), F.size("wa").alias("na"), F.size("wb").alias("nb"))
    return out.where(F.col("common") > F.greatest("na", "nb") * share)


def _substrings(x: Column, n: int) -> Column:
    """The distinct substrings of n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n))))


def containing_pairs(left: DataFrame, right: DataFrame, gram: int = 4) -> DataFrame:
    """left(s) x right(t), distinct texts, none empty: the pairs (s, t) of which one stands in the other, also inside words.

    A text of `gram` characters or more has its substrings of that length in a text around it, so its rarest one there is looked up;
    a shorter one is itself a substring of its length. Both directions come from one table of substrings.
    """
    rows = written(left.select(F.lit(0).alias("side"), F.col("s").alias("x")).unionByName(right.select(F.lit(1).alias("side"), F.col("t").alias("x"))), "texts")
    short = [r["n"] for r in rows.where(F.length("x") < gram).select(F.length("x").alias("n")).distinct().collect()]  # fewer than `gram`
    cut = F.explode(F.concat(*[F.when(F.length("x") >= n, _substrings(F.col("x"), n)).otherwise(F.array().cast("array<string>")) for n in sorted({gram, *short})]))
    keys = written(rows.select("side", "x", cut.alias("key")), "substrings")
    held = keys.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    there = F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0"))  # how many of the other side have it
    # the longest keys of a text tell where it can stand; one that the other side lacks tells that it stands nowhere
    own = keys.where(F.length("key") == F.least(F.length("x"), F.lit(gram))).join(held, "key").groupBy("side", "x").agg(F.min_by("key", F.struct(there, "key")).alias("key"), F.min(there).alias("least")).where("least > 0")
    around = keys.select((1 - F.col("side")).alias("side"), F.col("x").alias("y"), "key")
    met = own.join(around, ["side", "key"]).where(F.contains("y", "x"))
    first = F.col("side") == 0
    return met.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("s"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("t")).distinct()


def match_titles_overlap(left: DataFrame, right: DataFrame, least: float = 0.7) -> DataFrame:
    """left(a, title) x right(b, title): exact, else containment (the longer shared part wins), else word overlap over the larger set above `least`; one best row each."""
    x = written(left.select("a", T.normalized_cite(F.col("title")).alias("s")), "left")
    y = written(right.select("b", T.normalized_cite(F.col("title")).alias("t")).where("t <> ''").groupBy("t").agg(F.min("b").alias("b")), "right")
    forms = written(x.select("s").where("s <> ''").distinct(), "forms")
    exact = forms.join(y, F.col("s") == F.col("t")).select("s", "b", F.lit(3).alias("tier"), F.lit(1.0).alias("score"))
    ours, theirs = (f.select(F.col(k).alias(n), F.array_distinct(F.split(k, " ")).alias("words")) for f, k, n in ((forms, "s", "a"), (y, "t", "b")))
    near = overlap_pairs(ours, theirs, least).select(F.col("a").alias("s"), F.col("b").alias("t"), F.lit(1).alias("tier"), (F.col("common") / F.greatest("na", "nb")).alias("score"))
    inside = containing_pairs(forms, y.select("t")).select("s", "t", F.lit(2).alias("tier"), F.least(F.length("s"), F.length("t")).cast("double").alias("score"))
    loose = near.unionByName(inside).join(y, "t").select("s", "b", "tier", "score")
    best = exact.unionByName(loose).groupBy("s").agg(F.max_by(F.struct("b", "tier", "score"), F.struct("tier", "score", -F.col("b"))).alias("m"))
    return x.join(best, "s").select("a", "m.b", "m.tier", F.round("m.score", 6).alias("score"))


def match_metadata_jaccard(papers: DataFrame, feed: DataFrame) -> DataFrame:
    """papers(a, title) x feed(b, title): the feed row of the best word Jaccard, above 0.5 for up to four distinct words, else above 0.6."""
    x = papers.select("a", F.array_join(F.array_sort(T.word_set(F.col("title"))), " ").alias("words"))
    y = feed.select("b", F.array_join(F.array_sort(T.word_set(F.col("title"))), " ").alias("words")).where("words <> ''").groupBy("words").agg(F.min("b").alias("b"))
    ours, theirs = (f.select(F.col("words").alias(n), F.split("words", " ").alias("words")) for f, n in ((x.select("words").where("words <> ''").distinct(), "a"), (y.select("words"), "b")))
    # a Jaccard above 0.5 needs more than half of the larger set in common
    met = overlap_pairs(ours, theirs, 0.5).withColumn("score", F.col("common") / (F.col("na") + F.col("nb") - F.col("common")))
    good = met.where(F.col("score") > F.when(F.col("na") <= 4, 0.5).otherwise(0.6)).join(y.select(F.col("words").alias("b"), F.col("b").alias("row")), "b")
    best = good.groupBy("a").agg(F.max_by(F.struct("row", "score"), F.struct("score", -F.col("row"))).alias("m"))
    return x.join(best.withColumnRenamed("a", "words"), "words").select("a", F.col("m.row").alias("b"), F.round("m.score", 6).alias("score"))


def resolve_paper_keys(queries: DataFrame, papers: DataFrame) -> DataFrame:
    """queries(q) x papers(paper_id, arxiv_id, doi, slug): an exact key, preprint id without version, DOI without URL, then a slug that holds
    the query with blanks as `-`; the first strategy that hits wins, ties to the least id. Outer blanks do not count; an empty query finds nothing.

    Only queries without a key are looked for in slugs: of up to three characters as a substring of their length, longer ones by their rarest
    substring of four or, from eight characters on, of eight, so that what all slugs have in common joins nothing."""
    p = papers
    asked = queries.select("q", F.trim("q").alias("bare")).where("bare <> ''")
    keys = p.select("paper_id", F.explode(F.array(F.col("paper_id").cast("string"), "arxiv_id", "doi", "slug")).alias("bare")).where("bare is not null")
    exact = asked.join(keys, "bare").select("q", "paper_id", F.lit(0).alias("way"))
    arxiv = asked.withColumn("k", T.normalized_arxiv(F.col("bare"))).join(p.select("paper_id", F.col("arxiv_id").alias("k")), "k").select("q", "paper_id", F.lit(1).alias("way"))
    doi = asked.withColumn("k", T.normalized_doi(F.col("bare"))).join(p.select("paper_id", F.lower("doi").alias("k")), "k").select("q", "paper_id", F.lit(2).alias("way"))
    known = written(exact.unionByName(arxiv).unionByName(doi).groupBy("q").agg(F.min(F.struct("way", "paper_id")).alias("m")), "keys")
    low = F.replace(F.lower("bare"), F.lit(" "), F.lit("-"))
    open_q = asked.select("q", low.alias("low")).join(known.select("q"), "q", "left_anti")
    slugs = p.select("paper_id", F.col("slug").alias("slug")).where(F.contains("slug", F.lit("-")) & ~F.startswith("slug", F.lit("10.")) & ~F.regexp_like("slug", F.lit(r"^[0-9]{4}\.")))
    spots = slugs.select("paper_id", F.explode(F.concat(*[_substrings(F.col("slug"), n) for n in (1, 2, 3)])).alias("low"))
    hits = open_q.where(F.length("low") <= 3).join(spots.groupBy("low").agg(F.min("paper_id").alias("paper_id")), "low").select("q", "paper_id")
    for n, some in ((4, open_q.where(F.length("low").between(4, 7))), (8, open_q.where(F.length("low") >= 8))):
        own = some.select("q", "low", F.explode(_substrings(F.col("low"), n)).alias("gram"))
        spots = slugs.where(F.length("slug") >= n).select("paper_id", "slug", F.explode(_substrings(F.col("slug"), n)).alias("gram"))
        held = spots.groupBy("gram").agg(F.count("*").alias("n"))
        rare = own.join(held, "gram", "left").groupBy("q", "low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
        hits = hits.unionByName(rare.select("q", "low", "r.gram").join(spots, "gram").where(F.contains("slug", "low")).select("q", "paper_id"))
    found = hits.groupBy("q").agg(F.min(F.struct(F.lit(3).alias("way"), "paper_id")).alias("m"))
    return queries.join(known.unionByName(found), "q", "left").select("q", "m.paper_id", "m.way")


def latest_per_key(rows: DataFrame, key: str, order: list) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
