"""Text functions over columns. Java regular expressions with ASCII classes; nulls give null unless a docstring says otherwise."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

# Role and the words that show it in a normalized heading, first match wins.
ROLES = (
    ("abstract", ("abstract",)),
    ("introduction", ("introduction", "motivation")),
    ("related_work", ("related work", "prior work", "literature review")),
    ("background", ("background", "preliminaries", "preliminary")),
    ("method", ("method", "approach", "architecture", "framework", "model", "algorithm")),
    ("experiments", ("experiment", "evaluation", "experimental setup", "implementation")),
    ("results", ("results", "analysis", "ablation")),
    ("limitations", ("limitation", "threats to validity")),
    ("conclusion", ("conclusion", "discussion", "future work")),
    ("appendix", ("appendix", "supplement")),
    ("references", ("reference", "bibliography")),
)
# Venue and the pattern that shows it, first match wins.
VENUES = (
    ("neurips|nips", "NeurIPS"),
    ("icml", "ICML"),
    ("iclr", "ICLR"),
    ("aaai", "AAAI"),
    ("ijcai", "IJCAI"),
    ("naacl", "NAACL"),
    ("emnlp", "EMNLP"),
    (r"acl\b", "ACL"),
    ("cvpr", "CVPR"),
    ("iccv", "ICCV"),
    ("eccv", "ECCV"),
    ("siggraph", "SIGGRAPH"),
    ("acmsig|acmart", "ACM"),
    ("ieee", "IEEE"),
    ("nature", "Nature"),
    (r"science\b", "Science"),
    ("arxiv", "arXiv"),
    ("jmlr", "JMLR"),
    ("tpami", "TPAMI"),
    ("ijcv", "IJCV"),
    ("kdd", "KDD"),
    ("sigir", "SIGIR"),
    ("coling", "COLING"),
    ("mlsys", "MLSys"),
    ("aistats", "AISTATS"),
    ("recsys", "RecSys"),
)


def once(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))


def normalized_title(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def normalized_name(x: Column) -> Column:
    """NFKC, case folded, runs of non-word characters to one space. Spark has no Unicode normalisation, so Arrow batches go through pandas."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.str.normalize("NFKC").str.casefold().str.replace(r"[^\w]+", " ", regex=True).str.strip()

    return of(x)


def normalized_cite(x: Column) -> Column:
    """Lower case, other characters than letters, digits and blanks deleted (not turned to blanks)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9 \t\n\r]", ""), "[ \t\n\r]+", " "))


def squash_title(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def _plain_words(x: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(x, "[^a-zA-Z0-9 \t\n\r]", ""), "[ \t\n\r]+"), lambda w: w != "")


def title_identifier(x: Column) -> Column:
    """Capitalized words joined by `_`; `Untitled` without words."""
    words = F.transform(_plain_words(F.coalesce(x, F.lit(""))), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))
    return F.when(F.size(words) == 0, F.lit("Untitled")).otherwise(F.array_join(words, "_"))


def module_name(x: Column, most: int = 6) -> Column:
    return F.array_join(F.slice(F.transform(_plain_words(x), F.lower), 1, most), "_")


def safe_id(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_")


def is_safe_id(x: Column) -> Column:
    return x.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z")


def semantic_role(heading: Column) -> Column:
    def of(plain: Column) -> Column:
        out = F.lit(None).cast("string")
        for role, signs in reversed(ROLES):
            out = F.when(plain.rlike("|".join(signs)), F.lit(role)).otherwise(out)
        return out

    return once(normalized_title(heading), of)


def token_estimate(x: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(x) / 4).cast("int"))


def first_sentence(x: Column) -> Column:
    """The first sentence of more than 30 characters, else the first 200 characters."""
    marked = F.regexp_replace(F.trim(x), r"([.!?])[ \t\n\r]+", "$1\u0001")
    long = F.filter(F.transform(F.split(marked, "\u0001"), lambda v: F.trim(v)), lambda s: F.length(s) > 30)
    return F.coalesce(F.get(long, F.lit(0)), F.substring(x, 1, 200))


# Fixed values.
#: Openings of contribution statements, in the order in which they are collected.
CONTRIBUTIONS = (
    r"(?i)we\s+(?:propose|introduce|present|develop|design|show|demonstrate)\s+[^.]+",
    r"(?i)(?:our|the\s+main|a\s+key)\s+contribution[^.]*",
    r"(?i)this\s+(?:paper|work|study)\s+(?:proposes|introduces|presents|develops|shows)[^.]+",
)


def contributions(x: Column, most: int = 5) -> Column:
    """Distinct statements of more than 20 characters, cut to 200, the first `most`."""
    found = F.concat(*[F.regexp_extract_all(x, F.lit(p), F.lit(0)) for p in CONTRIBUTIONS])
    long = F.filter(F.transform(found, lambda v: F.trim(v)), lambda s: F.length(s) > 20)
    return F.slice(F.array_distinct(F.transform(long, lambda s: F.substring(s, 1, 200))), 1, most)


# Fixed value: words that show a method section.
METHOD_SIGNS = "method|approach|model|architecture|framework|proposed|technique|algorithm"


def method_overview(sections: Column) -> Column:
    """Of array<struct<heading, content>>: the first method-like section of more than 50 characters, cut to 500."""
    hit = F.filter(sections, lambda s: F.lower(s["heading"]).rlike(METHOD_SIGNS) & (F.length(s["content"]) > 50))
    body = F.get(hit, F.lit(0))["content"]
    return F.when(F.length(body) > 500, F.concat(F.substring(body, 1, 500), F.lit("..."))).otherwise(body)


def token_sorted(x: Column) -> Column:
    return F.array_join(F.array_sort(F.split(normalized_cite(x), " ")), " ")


def title_similarity(a: Column, b: Column) -> Column:
    """0 to 100: Levenshtein ratio of the token-sorted texts."""
    p, q = token_sorted(a), token_sorted(b)
    most = F.greatest(F.length(p), F.length(q))
    return F.when(most == 0, F.lit(0.0)).otherwise(F.lit(100.0) * (F.lit(1.0) - F.levenshtein(p, q) / most))


def word_set(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalized_cite(x), " "), lambda w: w != ""))


def word_jaccard(a: Column, b: Column) -> Column:
    p, q = word_set(a), word_set(b)
    n = F.size(F.array_union(p, q))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(p, q)) / n)


def word_overlap_max(a: Column, b: Column) -> Column:
    p, q = word_set(a), word_set(b)
    n = F.greatest(F.size(p), F.size(q))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(p, q)) / n)


def _year(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit("")).cast("int")


# Conferences and style files that carry a year.
CONFERENCES = "NeurIPS|NIPS|ICML|ICLR|AAAI|IJCAI|CVPR|ICCV|ECCV|ACL|EMNLP|NAACL|COLING|KDD|SIGIR|WWW|AISTATS|UAI|MLSys|RecSys|CIKM|WSDM|ALT"
STYLES = "icml|nips|neurips|cvpr|iccv|eccv|aaai|ijcai|acl|emnlp|naacl|coling|sigir|kdd|www|wsdm|cikm|recsys|mlsys|aistats|uai|alt"


def year_of(x: Column) -> Column:
    """struct<year, place>: the first that holds of eight places in markup, from the explicit year to the preprint id."""
    return once(x, _year_places)


def _style_year(styles: Column) -> Column:
    """Of the first style that names years: the first from 2015 to 2026, else the first."""
    years = F.transform(styles, lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"(?<![0-9])(20[012][0-9]|19[0-9][0-9])(?![0-9])")), lambda y: y.cast("int")))
    first = F.get(F.filter(years, lambda y: F.size(y) > 0), F.lit(0))
    return once(first, lambda y: F.coalesce(F.get(F.filter(y, lambda v: v.between(2015, 2026)), F.lit(0)), F.get(y, F.lit(0))))


def _year_places(x: Column) -> Column:
    digits = r"(?:^|[^0-9])((?:20[012][0-9])|(?:19[0-9][0-9]))(?:[^0-9]|$)"
    document = r"(?i)\\documentclass(?:\[([^\]]*)\])?\{([^}]*)\}"
    classes = F.zip_with(F.regexp_extract_all(x, F.lit(document), F.lit(1)), F.regexp_extract_all(x, F.lit(document), F.lit(2)), lambda a, b: F.concat_ws(" ", a, b))
    styles = F.concat(F.regexp_extract_all(x, F.lit(r"(?i)\\usepackage(?:\[[^\]]*\])?\{([^}]*[0-9]{4}[^}]*)\}")), classes)
    macro = _year(F.substring(x, 1, 15000), r"\\(?:def|newcommand|renewcommand)\{?\\[a-zA-Z]*[Yy]ear\}?\{([0-9]{4})\}")
    arxiv = _year(x, r"(?i)arxiv(?:\.org/abs/)?[:/]?\s*([0-9]{2})(?:0[1-9]|1[0-2])\.[0-9]{4,5}")
    found = (
        ("tex:acm_year", _year(x, r"\\acmYear\{([0-9]{4})\}")),
        ("tex:conference_style", _year(x, rf"\\usepackage(?:\[[^\]]*\])?\{{[^}}]*?(?:{STYLES})[a-z_-]*?([0-9]{{4}})")),
        ("tex:document_style", once(styles, _style_year)),
        ("tex:year_comment", _year(x, r"(?i)%\s*(?:year|date)\s*[:=]?\s*([0-9]{4})")),
        ("tex:date", _year(F.regexp_extract(x, r"\\date\{([^}]*)\}", 1), digits)),
        ("tex:conference_text", _year(F.substring(x, 1, 8000), rf"(?i)\b(?:{CONFERENCES})\s*([0-9]{{4}})\b")),
        ("tex:year_macro", F.when(macro.between(2010, 2026), macro)),
        ("tex:arxiv_submission", F.when(arxiv >= 90, 1900 + arxiv).otherwise(2000 + arxiv)),
    )
    hits = F.filter(F.array(*[F.struct(y.alias("year"), F.lit(n).alias("place")) for n, y in found]), lambda h: h["year"].isNotNull())
    return F.get(hits, F.lit(0))


def infer_year(x: Column, first: int = 2017) -> Column:
    """The most frequent year from `first` on among 20[12]d mentions; equal counts go to the one seen first."""
    years = F.regexp_extract_all(x, F.lit(r"\b(20[12][0-9])\b"))

    def best(recent: Column) -> Column:
        scored = F.transform(F.array_distinct(recent), lambda y: F.struct(F.size(F.filter(recent, lambda z: z == y)).alias("n"), (-F.array_position(recent, y)).alias("at"), y.alias("year")))
        return F.array_max(scored)["year"]

    return once(F.filter(F.transform(years, lambda y: y.cast("int")), lambda y: y >= first), best)


def detect_venue(x: Column) -> Column:
    def of(head: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, venue in reversed(VENUES):
            out = F.when(head.rlike(pattern), F.lit(venue)).otherwise(out)
        return out

    return once(F.lower(F.substring(x, 1, 5000)), of)


def arxiv_id(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"(?i)arxiv(?:\.org/abs/)?[:/]?\s*([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?", 1), F.lit(""))


def normalized_arxiv(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), "(?i)^(?:arxiv:)?([0-9]{4}\\.[0-9]{4,5})(?:v[0-9]+)?$", "$1")


def normalized_doi(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(x), "(?i)^https?://(?:dx\\.)?doi\\.org/", ""))


# Fixed value: commands that cite.
CITE = r"\\(?:cite|citep|citet|citealp|citeauthor|citeyear|shortcite|Cite)\*?(?:\[[^\]]*\]\s*)*\{([^}]*)\}"


def cite_keys(x: Column) -> Column:
    """All keys of citation commands, distinct and sorted."""
    keys = F.flatten(F.transform(F.regexp_extract_all(x, F.lit(CITE)), lambda k: F.split(k, r"[,\s]+")))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: (k != "") & ~k.startswith("%"))))


def replace_citations(x: Column) -> Column:
    """Citation commands to `[cite:a; b]` (`[cite]` without keys), references to `[ref:x]`, however many keys a command has."""
    between = F.split(x, CITE, -1)
    keys = F.transform(F.regexp_extract_all(x, F.lit(CITE)), lambda k: F.filter(F.split(k, r"[,\s]+"), lambda v: v != ""))
    marks = F.transform(keys, lambda k: F.when(F.size(k) > 0, F.concat(F.lit("[cite:"), F.array_join(k, "; "), F.lit("]"))).otherwise("[cite]"))
    marked = F.array_join(F.zip_with(between, marks, lambda t, m: F.concat(t, F.coalesce(m, F.lit("")))), "")
    return F.regexp_replace(marked, r"\\(?:ref|eqref|autoref|cref|Cref|nameref|hyperref|secref)\{\s*([^}]*?)\s*\}", "[ref:$1]")


def clean_markup(x: Column) -> Column:
    """Comments, formatting commands and macro definitions taken out; the text inside formatting commands stays."""
    # the lists of commands are fixed values
    x = F.regexp_replace(x, r"(?m)(^|[^\\])%.*$", "$1")
    x = F.regexp_replace(x, r"\\(?:textbf|textit|emph|underline|textsc|texttt|textsf|textrm|mathrm|mathbf|mathit|mathsf|mathtt|mathcal|mathbb|mathfrak|boldsymbol|bm)\{([^}]*)\}", "$1")
    x = F.regexp_replace(x, r"\\(?:re)?newcommand\{[^}]*\}(?:\[[0-9]\])?\{[^}]*\}", "")
    return F.regexp_replace(x, r"\\(?:Large|LARGE|huge|Huge|large|small|footnotesize|normalsize|scriptsize|tiny|centering|raggedright|raggedleft|bfseries|itshape|slshape|scshape|mdseries|bf|it|sl|sc|rm|sf|tt)\b\s*", "")


#: Ligatures and what they stand for. Fixed values.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))


def dehyphenate(x: Column) -> Column:
    """Ligatures spelled out, soft hyphens dropped, words joined over a line-end hyphen, blanks collapsed within lines, blank lines to one."""
    for a, b in LIGATURES:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.regexp_replace(F.replace(x, F.lit("\u00ad"), F.lit("")), r"([A-Za-z0-9_])-\n[ \t\n]*([a-z])", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), " ?\n ?", "\n"), "\n{3,}", "\n\n"))


def bibtex_authors(x: Column) -> Column:
    """`Last, First and ...` to an array of `First Last`; `von Last, Jr, First` forms in three parts."""

    def one(raw: Column) -> Column:
        bare = F.trim(F.regexp_replace(raw, "[{}]", ""))
        parts = F.filter(F.transform(F.split(bare, ","), lambda v: F.trim(v)), lambda p: p != "")
        flipped = F.when(F.size(parts) == 2, F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).when(F.size(parts) == 3, F.concat_ws(" ", F.get(parts, F.lit(2)), F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(bare)
        return F.trim(F.regexp_replace(flipped, r"\s+", " "))

    return F.filter(F.transform(F.split(x, r"\s+and\s+"), one), lambda a: a != "")


# Metric, pattern, and whether values over 1 are percentages.
RUN_METRICS = (
    ("accuracy", r"(?i)accuracy[:\s=]+([0-9.]+)", True),
    ("val_accuracy", r"(?i)val_accuracy[:\s=]+([0-9.]+)", True),
    ("loss", r"(?i)\bloss[:\s=]+([0-9.]+)", False),
    ("val_loss", r"(?i)\bval_loss[:\s=]+([0-9.]+)", False),
    ("f1_score", r"(?i)f1[:\s=]+([0-9.]+)", True),
    ("bleu", r"(?i)bleu[:\s=]+([0-9.]+)", True),
    ("map", r"(?i)\b(?:AP|map)[:\s=]+([0-9.]+)", True),
)


def _ratio(v: Column, percent: bool) -> Column:
    return F.when(v > 1, v / 100.0).otherwise(v) if percent else v


def run_metrics(log: Column) -> Column:
    """array<struct<name, value>>: the last value of each metric in a log."""
    out = []
    for name, pattern, percent in RUN_METRICS:
        last = F.try_element_at(F.regexp_extract_all(log, F.lit(pattern)), F.lit(-1)).try_cast("double")
        out.append(F.struct(F.lit(name).alias("name"), _ratio(last, percent).alias("value")))
    return F.filter(F.array(*out), lambda m: m["value"].isNotNull())


# Metric, prose patterns, names of table rows, whether lower is better, whether values over 1 are percentages.
PAPER_METRICS = (
    ("accuracy", (r"(?i)(?:accuracy|acc)\s*[:=]\s*([0-9]+\.?[0-9]*)", r"(?i)(?:accuracy|acc)\s*(?:of|is|was|reaches?|achieves?|obtains?|attains?)\s*([0-9]+\.?[0-9]*)"), ("accuracy", "acc"), False, True),
    ("f1_score", (r"(?i)(?:f1[- ]?score|f1)\s*[:=]\s*([0-9]+\.?[0-9]*)", r"(?i)(?:f1[- ]?score|f1)\s*(?:of|is|was|reaches?|achieves?)\s*([0-9]+\.?[0-9]*)"), ("f1", "f1 score", "f1-score"), False, True),
    ("bleu", (r"(?i)bleu\s*[:=]\s*([0-9]+\.?[0-9]*)", r"(?i)bleu\s*(?:of|is|was|reaches?|achieves?)\s*([0-9]+\.?[0-9]*)"), ("bleu",), False, True),
    ("perplexity", (r"(?i)(?:perplexity|ppl)\s*[:=]\s*([0-9]+\.?[0-9]*)",), ("perplexity", "ppl"), True, False),
    ("rouge_l", (r"(?i)rouge[- ]?l\s*[:=]\s*([0-9]+\.?[0-9]*)",), ("rouge-l", "rouge l"), False, True),
    ("map", (r"(?i)(?:map|mean\s+average\s+precision|\bAP)\s*[:=]\s*([0-9]+\.?[0-9]*)",), ("map",), False, True),
    ("loss", (r"(?i)\bloss\s*[:=]\s*([0-9]+\.?[0-9]*)",), ("loss",), True, False),
    ("exact_match", (r"(?i)(?:exact\s+match|em)\s*[:=]\s*([0-9]+\.?[0-9]*)",), ("em", "exact match"), False, True),
    ("auc", (r"(?i)\bauc\s*[:=]\s*([0-9]+\.?[0-9]*)",), ("auc",), False, True),
    ("precision", (r"(?i)\bprecision\s*[:=]\s*([0-9]+\.?[0-9]*)",), ("precision",), False, True),
    ("recall", (r"(?i)\brecall\s*[:=]\s*([0-9]+\.?[0-9]*)",), ("recall",), False, True),
)


def _number(v: Column) -> Column:
    return v.try_cast("double")


def _percentage(v: Column) -> Column:
    return _ratio(_number(v), True)


def paper_metrics(x: Column) -> Column:
    """array<struct<name, value>> of reported metrics: a table row if there is one, else the first prose form that occurs, best value by direction."""
    out = []
    for name, patterns, rows, lower, percent in PAPER_METRICS:
        cell = F.regexp_extract(x, r"(?i)\|\s*(?:" + "|".join(rows) + r")\s*\|\s*([0-9]+\.?[0-9]*)\s*%?\s*\|", 1)
        value = _ratio(F.nullif(cell, F.lit("")).try_cast("double"), percent)
        ratio = _percentage if percent else _number
        for p in patterns:
            values = F.transform(F.regexp_extract_all(x, F.lit(p)), ratio)
            value = F.coalesce(value, F.array_min(values) if lower else F.array_max(values))
        out.append(F.struct(F.lit(name).alias("name"), value.alias("value")))
    return F.filter(F.array(*out), lambda m: m["value"].isNotNull())


# Parameter, type, patterns in order.
HYPERPARAMETERS = (
    ("learning_rate", "double", (r"(?i)learning\s+rate\s*(?:of|is|=|:)\s*([0-9.e\-]+)", r"(?i)lr\s*=\s*([0-9.e\-]+)")),
    ("batch_size", "int", (r"(?i)batch\s+size\s*(?:of|is|=|:)\s*([0-9]+)", r"(?i)batch\s*=\s*([0-9]+)")),
    ("epochs", "int", (r"(?i)([0-9]+)\s+epochs", r"(?i)epochs\s*=\s*([0-9]+)")),
    ("optimizer", "string", (r"(?i)optimizer\s*(?:is|=|:)\s*([A-Za-z0-9_]+)", r"(?i)using\s+([A-Za-z0-9_]+)\s+optimizer", r"(?i)optimized\s+by\s+([A-Za-z0-9_]+)")),
    ("weight_decay", "double", (r"(?i)weight\s+decay\s*(?:of|is|=|:)\s*([0-9.e\-]+)",)),
    ("warmup_steps", "int", (r"(?i)warmup\s+steps\s*(?:of|is|=|:)\s*([0-9]+)",)),
)


def hyperparameters(x: Column) -> Column:
    """struct of the parameters: the first pattern that occurs, null where its text is not of the type."""
    out = []
    for name, kind, patterns in HYPERPARAMETERS:
        raw = F.coalesce(*[F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in patterns])
        out.append((raw if kind == "string" else raw.try_cast(kind)).alias(name))
    return F.struct(*out)


def log_clean(x: Column) -> Column:
    """Tags and control characters to blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "<[^<>]*>", " "), "[\\x00-\\x1f\\x7f]", " "), " +", " "))


def project_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9_-]+", "-")


def mixed_text(x: Column) -> Column:
    """Text of a marked-up fragment: inline math as `$tex$`, citations as `[ids]`, other tags dropped, blanks collapsed."""
    x = F.regexp_replace(x, r'(?s)<Math[^>]*\btex="([^"]*)"[^>]*?(?:/>|>.*?</Math>)', r"\$$1\$")
    x = F.regexp_replace(x, r'(?s)<(?:bibref|ref)\b[^>]*\b(?:bibrefs|labelref|idref)="([^"]*)"[^>]*?(?:/>|>.*?</(?:bibref|ref)>)', "[$1]")
    x = F.regexp_replace(x, "<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def quote(x: Column, most: int = 500) -> Column:
    return F.left(x, F.lit(most))


# Signs of an affiliation; ones of at most four characters must stand alone.
AFFILIATIONS = (
    "department", "university", "institute", "college", "school", "laboratory", "lab", "address", "faculty", "center", "centre", "research", "division", "technology", "engineering", "science",
    "affiliation", "correspondence", "email", "http", "www", "inc.", "inc,", "corp.", "corp,", "ltd", "llc", "academy", "digital economy",
    "google", "microsoft", "meta", "openai", "deepmind", "anthropic", "nvidia", "intel", "ibm", "amazon", "facebook", "apple", "twitter", "salesforce",
    "ai language", "ai research", "ai team", "tech limited", "villa tech",
    "mountain view", "palo alto", "san francisco", "san jose", "los angeles", "new york", "menlo park", "redwood city", "san diego",
)


def is_affiliation(x: Column) -> Column:
    low, bare = F.lower(x), F.trim(x)
    short, long = ([re.escape(k) for k in AFFILIATIONS if (len(k) <= 4) == few] for few in (True, False))
    return (
        low.rlike("|".join(long))
        | low.rlike(r"\b(?:" + "|".join(short) + r")\b")
        | (x.rlike(r"\b[0-9]{2,}\b") & low.rlike("street|road|avenue|ave|blvd|drive|way"))
        | bare.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*[A-Z]{2}$")
        | bare.rlike(r"^[A-Z]{2,5}$")
        | bare.rlike(r"^\[[0-9]+\]")
    )


def split_authors(x: Column) -> Column:
    """Names between commas, semicolons and `and`, affiliations left out."""
    return F.filter(F.transform(F.split(x, r"\s*(?:,|;|\band\b|\\and\b)\s*"), lambda v: F.trim(v)), lambda a: (a != "") & ~is_affiliation(a))


# Headings known without a number.
KNOWN_HEADINGS = (
    "INTRODUCTION", "BACKGROUND", "RELATED WORK", "METHOD", "METHODS", "METHODOLOGY", "APPROACH", "MODEL", "EXPERIMENTS", "EXPERIMENTAL SETUP", "RESULTS",
    "DISCUSSION", "CONCLUSION", "CONCLUSIONS", "LIMITATIONS", "ACKNOWLEDGMENTS", "ACKNOWLEDGEMENTS", "REFERENCES", "APPENDIX",
)


def heading_level(line: Column) -> Column:
    """Dots + 1 of a numbered heading, 1 of a known one, else null: at most 110 characters, and a numbered one at least 65 % capitals or in title case."""
    bare = F.trim(F.regexp_replace(line, r"\s+", " "))
    numbered = r"^([0-9]+(?:\.[0-9]+)*)\s+([A-Z][A-Za-z0-9 ,:;()/'&+\-]{2,100})$"
    number, head = F.regexp_extract(bare, numbered, 1), F.regexp_extract(bare, numbered, 2)
    letters = F.regexp_count(head, F.lit("[A-Za-z]"))
    # title case: no small letter after another character than a letter, no capital after a letter
    titled = ~head.rlike("(?:^|[^A-Za-z])[a-z]") & ~head.rlike("[A-Za-z][A-Z]")
    looks = (letters > 0) & ((F.regexp_count(head, F.lit("[A-Z]")) >= letters * 0.65) | titled)
    known = F.regexp_replace(F.upper(bare), ":+$", "").isin(*KNOWN_HEADINGS)
    return F.when((bare == "") | (F.length(bare) > 110), F.lit(None)).when((number != "") & looks, F.regexp_count(number, F.lit(r"\.")) + 1).when(known, F.lit(1)).cast("int")


def clean_title(x: Column) -> Column:
    """Markup, footnotes and line breaks out of a title."""
    x = F.regexp_replace(x, r"\\(?:thanks|footnote|footnotemark|vspace|hspace)\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})?", "")
    x = F.regexp_replace(clean_markup(x), r"\\\\(?:\[[^\]]*\])?|~", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\\[a-zA-Z]+\*?", " "), "[{}$]", ""), r"\s+", " "))


def clean_abstract(x: Column) -> Column:
    x = F.regexp_replace(replace_citations(clean_markup(x)), r"\\(?:begin|end)\{[^}]*\}|\\label\{[^}]*\}", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i)^\s*abstract\s*[:.—-]*\s*", ""), r"\s+", " "))


def document_year(notes: Column, dates: Column) -> Column:
    """The first 19dd or 20dd in the dates, else in the notes (arrays of text)."""
    return F.coalesce(_year(F.array_join(dates, " "), r"((?:19|20)[0-9]{2})"), _year(F.array_join(notes, " "), r"((?:19|20)[0-9]{2})"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 32 hex digits of the SHA-256 of the parts, joined by U+001F; null parts count as empty."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32))


def canonical_digest(record: Column) -> Column:
    """SHA-256 of a struct as JSON; its fields are in the order given, so callers name them sorted."""
    return F.sha2(F.to_json(record), 256)


def canonical_xml(x: Column) -> Column:
    """The canonical form (C14N 2.0) of XML text: attributes in order, entities and empty tags written out, so that serialisations of one document are equal. Null if it is no XML."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xml.etree.ElementTree as ET

        def one(text):
            try:
                return ET.canonicalize(xml_data=text) if isinstance(text, str) else None
            except ET.ParseError:
                return None

        for s in batches:
            yield pd.Series([one(t) for t in s], dtype=object)

    return of(x)
