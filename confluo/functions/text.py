"""Column expressions over text: normalisation, blocks, similarity, paths, template tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, for regular expressions.
BLANK = r"(?U)\s"
#: Weights of content, length and position, and the threshold of a refined match.
WEIGHTS, REFINED = (0.7, 0.15, 0.15), 0.7


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def blocks(text: Column) -> Column:
    """Normalised blocks of a text: cut at empty lines, white space collapsed, empty ones dropped."""
    whole = F.regexp_replace(unix_lines(text), r"(?U)^\s+|\s+$", "")
    clean = F.transform(F.split(whole, "\n\n"), lambda b: F.trim(F.regexp_replace(b, f"{BLANK}+", " ")))
    return F.filter(clean, lambda b: b != "")


def normalized(text: Column) -> Column:
    return F.array_join(blocks(text), "\n\n")


def spans(bs: Column) -> Column:
    """Of an array of blocks: (idx, normalized, start, end), byte spans of blocks two bytes apart."""
    starts = F.aggregate(bs, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.octet_length(x) + 2)))
    placed = F.arrays_zip(bs.alias("b"), F.slice(starts, 1, F.size(bs)).alias("start"))
    return F.transform(placed, lambda x, i: F.struct(i.alias("idx"), x["b"].alias("normalized"), x["start"].alias("start"), (x["start"] + F.octet_length(x["b"])).alias("end")))


def token_set(text: Column) -> Column:
    """Sorted distinct words between white space."""
    return F.array_sort(F.filter(F.array_distinct(F.split(text, f"{BLANK}+")), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def string_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length in code points."""
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def length_similarity(a: Column, b: Column) -> Column:
    """Shorter over longer length in bytes; two empty texts are alike."""
    longer = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longer == 0, 1.0).otherwise(F.least(F.octet_length(a), F.octet_length(b)) / longer)


def relative_position(index: Column, total: Column) -> Column:
    return F.when(total <= 1, 0.5).otherwise(index / (total - 1))


def position_similarity(i: Column, j: Column, n: Column, m: Column) -> Column:
    return 1 - F.abs(relative_position(i, n) - relative_position(j, m))


def refined_similarity(a: Column, b: Column, i: Column, j: Column, n: Column, m: Column) -> Column:
    content, length, position = WEIGHTS
    return content * string_similarity(a, b) + length * length_similarity(a, b) + position * position_similarity(i, j, n, m)


def similarity_score(a: Column, b: Column) -> Column:
    """Mean Jaccard of blocks paired by number, over the larger number of blocks; no blocks at all are alike."""
    left, right = blocks(a), blocks(b)
    n = F.greatest(F.size(left), F.size(right))
    pairs = F.zip_with(left, right, lambda x, y: F.when(x.isNull() | y.isNull(), 0.0).otherwise(jaccard(token_set(x), token_set(y))))
    return F.when(n == 0, 1.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / n)


def slug(value: Column) -> Column:
    """Lower case, runs of other than [a-z0-9] as one dash, none at the ends; ``section`` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit("")), F.lit("section"))


def pointer_segment(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_join(parent: Column, segment: Column) -> Column:
    return F.concat(parent, F.lit("/"), pointer_segment(segment))


TOKEN = r"\{([^}]*)\}"
#: A key of the default configuration: segments of word characters, the first boundary "|", later ones ":".
KEY = r"^[A-Za-z0-9_]+\|[A-Za-z0-9_]+(:[A-Za-z0-9_]+)*$"


def token_keys(content: Column) -> Column:
    """Valid keys of ``{A|B:C}`` tokens, each once, in order of appearance; scanning goes on after each closing brace."""
    return F.array_distinct(F.filter(F.regexp_extract_all(content, F.lit(TOKEN), F.lit(1)), lambda k: k.rlike(KEY)))


def unresolved_keys(content: Column, replacements: dict[str, str]) -> Column:
    return F.array_except(token_keys(content), F.array(*[F.lit(k) for k in replacements]).cast("array<string>"))


def resolve_tokens(content: Column, replacements: dict[str, str]) -> Column:
    """Each key's tokens replaced in turn, keys in sorted order; a replacement's own tokens may be replaced later."""
    return reduce(lambda c, k: F.replace(c, F.lit("{" + k + "}"), F.lit(replacements[k])), sorted(replacements), content)


def conflict_document(ours: Column, base: Column, theirs: Column, size: int = 7) -> Column:
    mark = lambda c: c * size
    return F.concat_ws("\n", F.lit(mark("<") + " ours"), ours, F.lit(mark("|") + " base"), base, F.lit(mark("=")), theirs, F.lit(mark(">") + " theirs"))


def first_non_empty(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def sanitized_language(name: Column) -> Column:
    """Lower case without anything but [a-z0-9_]; null if empty or not starting with a letter."""
    clean = F.regexp_replace(F.lower(name), "[^a-z0-9_]", "")
    return F.when(clean.rlike("^[a-z]"), clean)


def library_path_errors(path: Column) -> Column:
    """Codes of the path rules that a library path breaks."""
    rules = [
        (path == "", "empty"),
        (F.octet_length(path) > 4096, "too_long"),
        (F.instr(path, "\0") > 0, "null_byte"),
        (~path.rlike(r"^(/|[A-Za-z]:[\\/])"), "not_absolute"),
        (F.array_contains(F.split(path, r"[/\\]"), ".."), "traversal"),
        (~path.rlike(r"\.(so|dylib|dll)(\.[0-9]+)*$"), "extension"),
        (~F.regexp_extract(path, r"([^/\\]*)$", 1).rlike(r"^[A-Za-z0-9_.-]+$"), "filename"),
    ]
    return F.array_compact(F.array(*[F.when(bad, code) for bad, code in rules]))
