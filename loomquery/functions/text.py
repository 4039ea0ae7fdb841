"""Text functions as Column expressions: folding, tokens, phrase match, score cascades, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomquery.functions.kernels import clamp, col, jaccard

#: Letters that fold to plain ones before comparison.
FOLD_FROM, FOLD_TO = "çğıöşüâîûéèêëáàäãåíìïóòôõúùñ", "cgiosuaiueeeeaaaaaiiioooouun"


def fold(c: Column | str) -> Column:
    """Trimmed lower case without the accents of FOLD_FROM; the dotted capital I is folded before lower()."""
    dotted = F.translate(F.trim(col(c)), "İI", "ii")
    return F.translate(F.lower(dotted), FOLD_FROM, FOLD_TO)


def turkish_lower(c: Column | str) -> Column:
    """Lower case by the Turkish rule: the dotted capital loses its dot's letter, the plain one becomes dotless."""
    return F.lower(F.translate(col(c), "İI", "iı"))


#: What a concept's name may end in without being another concept.
CONCEPT_ENDINGS = ["print", "desen", "deseni", "pattern", "baski"]


def concept_key(c: Column | str) -> Column:
    """Key under which spellings of a concept meet: punctuation, dashes and underscores as spaces, folded, and without one
    of CONCEPT_ENDINGS each, in their order, if more than two letters stay."""
    plain = F.regexp_replace(F.translate(col(c), "–—-_", "    "), r"[^\p{L}\p{N}\s]+", " ")
    key = F.trim(F.regexp_replace(F.translate(turkish_lower(plain), FOLD_FROM, FOLD_TO), r"\s+", " "))
    for end in CONCEPT_ENDINGS:
        key = F.when(key.endswith(" " + end) & (F.length(key) > len(end) + 3), F.trim(F.substr(key, F.lit(1), F.length(key) - len(end) - 1))).otherwise(key)
    return key


def brand_key(c: Column | str) -> Column:
    """Trimmed lower case, the Turkish letters and é folded, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.trim(col(c))), "çğıöşüé", "cgiosue"), r"\s+", " "))


def customer_key(c: Column | str) -> Column:
    """Folded, punctuation as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), r"[^\p{L}\p{N}\s]+", " "), r"\s+", " "))


def name_boost(query: Column, name: Column | str) -> Column:
    """.88 if all of the query's tokens are in the file name, .80 if the name holds the query as it is; folders play no part."""
    stem = F.regexp_replace(F.lower(col(name)), r"\.[a-z0-9]+$", "")
    mine = tokens(query)
    all_there = (F.size(mine) > 0) & (F.size(F.array_except(mine, tokens(stem))) == 0)
    return F.when(F.length(query) == 0, 0.0).when(all_there, 0.88).when(F.contains(F.lower(col(name)), query), 0.80).otherwise(0.0)


def search_blob(*parts: Column | str) -> Column:
    """One folded text of all parts that are not empty, each once, in order."""
    plain = F.transform(F.array(*[F.coalesce(fold(p), F.lit("")) for p in parts]), lambda x: F.trim(F.regexp_replace(x, r"[_\-\s]+", " ")))
    return F.array_join(F.array_distinct(F.filter(plain, lambda x: x != "")), " ")


def tokens(c: Column | str, least: int = 2) -> Column:
    """Distinct tokens of letters a-z and digits, at least `least` long, in order of first appearance."""
    return F.array_distinct(F.filter(F.split(F.lower(col(c)), "[^a-z0-9]+"), lambda t: F.length(t) >= least))


def has_phrase(text: Column | str, phrase: str) -> Column:
    """Whole-word match: the phrase with no letter or digit beside it."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", " "), F.lit(" "))
    return padded.contains(" " + " ".join(phrase.lower().split()) + " ")


def text_score(title: Column, body: Column, query: Column) -> Column:
    """Cascade over folded text: equal, prefix, whole phrase, token overlap, substring; 0 when nothing matches."""
    over = jaccard(tokens(query), tokens(title))
    return (
        F.when(F.length(query) == 0, 0.0).when(title == query, 0.98).when(title.startswith(query), 0.95)
        .when(F.concat(F.lit(" "), title, F.lit(" ")).contains(F.concat(F.lit(" "), query, F.lit(" "))), 0.92)
        .when(over > 0, clamp(0.82 + 0.08 * over)).when(title.contains(query), 0.55).when(body.contains(query), 0.38).otherwise(0.0)
    )


def extension(path: Column | str) -> Column:
    """Lower-cased text after the last dot of the last path segment; empty without one."""
    return F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))


def variant_stem(name: Column | str) -> Column:
    """File stem without its extension and its trailing size, version or finish marks."""
    stem = F.regexp_replace(F.lower(col(name)), r"\.[a-z0-9]+$", "")
    marks = r"([ _-]+(xs|s|m|l|xl|xxl|final|copy|v[0-9]+|rev[0-9]+|[0-9]+))+$"
    return F.regexp_replace(F.regexp_replace(stem, marks, ""), r"[ _-]+", "_")


def under(path: Column | str, prefix: str) -> Column:
    """The path is the prefix or lies below it, at a separator."""
    p = prefix.rstrip("/")
    return (col(path) == p) | col(path).startswith(p + "/")


def host(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[a-z]+://([^/]+)", 1)


def first_segment(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[a-z]+://[^/]+/([^/?#]*)", 1)


def file_size(c: Column | str) -> Column:
    """Readable size: B, KB, MB or GB with one decimal beyond bytes."""
    n = col(c).cast("double")
    unit = lambda d, s: F.concat(F.format_string("%.1f", n / d), F.lit(" " + s))
    return F.when(n < 1024, F.concat(F.format_string("%d", col(c).cast("long")), F.lit(" B"))).when(n < 1024**2, unit(1024.0, "KB")).when(n < 1024**3, unit(1024.0**2, "MB")).otherwise(unit(1024.0**3, "GB"))


#: Parts of a share's name that tell a backup store.
STORE_MARKS = ["NAS", "BACKUP", "YEDEK", "ARCHIVE", "ARŞIV", "ARSIV"]


def source_root(path: Column | str) -> Column:
    r"""Canonical root: backslashes, one between parts, a share with two in front, none at the end."""
    raw = F.replace(F.trim(col(path)), F.lit("/"), F.lit("\\"))
    parts = F.array_join(F.filter(F.split(raw, r"\\"), lambda x: x != ""), "\\")
    return F.when(raw.startswith("\\"), F.concat(F.lit("\\\\"), parts)).otherwise(parts)


def source_type(path: Column | str) -> Column:
    """local_pc, server_share or nas_backup, from the root."""
    root = source_root(path)
    store = F.lit(False)
    for mark in STORE_MARKS:
        store = store | F.upper(root).contains(mark)
    return F.when(~root.startswith("\\\\"), "local_pc").when(store, "nas_backup").otherwise("server_share")


def phrases(c: Column | str, longest: int = 3) -> Column:
    """Distinct runs of one to `longest` words of folded text: what whole-phrase aliases can be joined on."""
    words = F.filter(F.split(fold(c), "[^a-z0-9]+"), lambda w: w != "")
    runs = [F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i, n=n: F.array_join(F.slice(words, i, n), " ")) for n in range(1, longest + 1)]
    return F.array_distinct(F.filter(F.concat(*runs), lambda x: x != ""))
