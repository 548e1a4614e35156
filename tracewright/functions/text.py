"""Text functions over columns. Null text counts as empty throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions import rules


def text_of(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def normalized(x: Column) -> Column:
    """Lower-cased ASCII letters and digits, one space between."""
    return F.trim(F.regexp_replace(F.lower(text_of(x)), "[^a-z0-9]+", " "))


def word_norm(x: Column) -> Column:
    """Lower-cased, runs of non-word characters (Unicode) as one space."""
    return F.trim(F.regexp_replace(F.lower(text_of(x)), r"(?U)\W+", " "))


def decimals(x: Column, n: int) -> Column:
    """A number with ``n`` decimals as printf rounds it: by the double's exact value, halves to the even digit.

    ``format_string`` rounds the shortest decimal form instead, so 599.05 goes up though the double is less. Up to 1e9 the
    number of half units is told with its rounding error (the product by halves of the double's digits, which are exact)."""
    x, y = x.cast("double"), F.lit(2.0 * 10**n)
    upper = x * 134217729.0 - (x * 134217729.0 - x)
    halves, rest = F.rint(x * y), (upper * y - x * y) + (x - upper) * y
    over = (x * y - halves) + rest
    low = (halves - 1) / 2
    units = F.when(halves % 2 == 0, halves / 2).when((over > 0) | ((over == 0) & (low % 2 != 0)), low + 1).otherwise(low)
    return F.format_string(f"%.{n}f", F.when(F.abs(x) < 1e9, units / float(10**n)).otherwise(x))


def tokens(x: Column) -> Column:
    """Distinct runs of three or more letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_of(x)), F.lit("([a-z0-9]{3,})"), F.lit(1)))


def content_tokens(x: Column) -> Column:
    """Distinct normalised words that aren't stopwords."""
    words = F.filter(F.split(normalized(x), " "), lambda w: w != "")
    return F.array_distinct(F.array_except(words, F.array(*map(F.lit, rules.STOPWORDS))))


def jaccard(a: Column, b: Column, both_empty: float, one_empty: float = 0.0) -> Column:
    both = F.size(F.array_union(a, b))
    empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(empty, F.lit(both_empty)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(one_empty)).otherwise(F.size(F.array_intersect(a, b)) / both)


def matches_any(x: Column, patterns: list[str]) -> Column:
    return x.rlike("|".join(f"(?:{p})" for p in patterns))


def contains_any(x: Column, terms: list[str]) -> Column:
    return matches_any(x, [t.replace(".", r"\.") for t in terms])


def best_class(x: Column, classes: dict[str, list[str]], default: str) -> Column:
    """The class of which most terms occur in the text; of equals the first; the default if none occurs."""
    low = F.lower(text_of(x))
    score = lambda terms: reduce(lambda a, b: a + b, [low.contains(t).cast("int") for t in terms])
    ranked = F.array(*[F.struct(score(terms).alias("n"), F.lit(-i).alias("at"), F.lit(name).alias("name")) for i, (name, terms) in enumerate(classes.items())])
    best = F.array_max(ranked)
    return F.when(best["n"] > 0, best["name"]).otherwise(default)


def system_of(x: Column) -> Column:
    return best_class(x, rules.SYSTEMS, "Other")


def hint_of(x: Column) -> Column:
    return best_class(x, rules.HINTS, "review")


def roots_of(words: Column) -> Column:
    """The words of an array without the endings ing, ed and s, in this order, where enough is left; creat as create."""
    for end, left in (("ing", 3), ("ed", 3), ("s", 4)):
        words = F.transform(words, lambda w: F.when(w.endswith(end) & (F.length(w) >= left + len(end)), F.left(w, F.length(w) - len(end))).otherwise(w))
    return F.transform(words, lambda w: F.when(w == "creat", "create").otherwise(w))


def verb_root(w: Column) -> Column:
    return F.get(roots_of(F.array(w)), F.lit(0))


def action_roots(x: Column) -> Column:
    return F.array_distinct(roots_of(F.filter(F.split(normalized(x), " "), lambda w: w != "")))


def meaningful(action: Column) -> Column:
    return F.arrays_overlap(action_roots(action), F.array(*map(F.lit, rules.VERBS))) | normalized(action).rlike(r"\bstart\s+creat")


def checkpoint(action: Column, expected: Column) -> Column:
    """A step that validates an output."""
    a = normalized(action)
    verb = matches_any(a, [rf"\b{v}\b" for v in rules.CHECK_VERBS])
    return verb & (a.rlike(r"\bthat\b") | matches_any(normalized(expected), [rf"\b{v}\b" for v in rules.CHECK_OUTPUTS]))


def noise(action: Column, expected: Column, acts: Column | None = None) -> Column:
    """``acts``: whether the action is meaningful, if that is known already."""
    both = F.trim(F.concat_ws(" ", normalized(action), normalized(expected)))
    always = matches_any(both, ["presenter", "outro", "social", "youtube", "subscribe"])
    return matches_any(both, rules.NOISE) & (always | ~(meaningful(action) if acts is None else acts))


def passive(action: Column, expected: Column, acts: Column | None = None, checks: Column | None = None) -> Column:
    """``acts``, ``checks``: whether the step is meaningful and a checkpoint, if that is known already."""
    seen = matches_any(normalized(action), rules.PASSIVE) | normalized(expected).rlike(r"\bscreen is visible\b|\bscreen remains visible\b")
    return seen & ~(checkpoint(action, expected) if checks is None else checks) & ~(meaningful(action) if acts is None else acts)


def review_style(action: Column) -> Column:
    return normalized(action).rlike("^(review|validate|verify|confirm that) ")


def redacted(x: Column) -> Column:
    """Exact values hidden, Click as Select, Type as Enter, spaces squeezed."""
    out = F.regexp_replace(text_of(x), rules.EXACT_VALUE, "the visible value")
    out = F.regexp_replace(out, r"\b[Cc]lick\b", "Select")
    out = F.regexp_replace(out, r"\b[Tt]ype\b", "Enter")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def clean_lines(x: Column, most: int = 28) -> Column:
    """Lines worth keeping: squeezed, three characters at least, no menu or clock noise, first of equals, with a
    business term or seven characters; ``most`` at the most."""
    lines = F.transform(F.split(text_of(x), r"\r\n|\n|\r"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    lines = F.filter(lines, lambda s: (F.length(s) >= 3) & ~matches_any(F.lower(s), rules.LINE_NOISE))
    low = F.transform(lines, F.lower)
    first = F.filter(lines, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)
    return F.array_join(F.slice(F.filter(first, lambda s: (F.length(s) >= 7) | contains_any(F.lower(s), rules.LINE_KEYWORDS)), 1, most), "\n")


def generic_review(action: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text_of(action)), "[^a-z0-9 ]+", " ")).rlike("^(" + "|".join(rules.GENERIC_REVIEWS) + ")")


def text_strength(x: Column) -> Column:
    """0 to 1 by the number of tokens and of characters."""
    n, size = F.size(tokens(x)), F.length(F.trim(text_of(x)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 0.55 * F.least(F.lit(1.0), n / 18) + 0.45 * F.least(F.lit(1.0), size / 180)))


def hash_distance(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hex; 64 when either isn't one."""
    return bits_apart(hash_bits(a), hash_bits(b))


def hash_bits(x: Column) -> Column:
    """A 64-bit hash in hex as a number; null if it isn't one."""
    return F.when(x.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(x, 16, -10).cast("long"))


def bits_apart(a: Column, b: Column) -> Column:
    """Differing bits of two numbers; 64 when either is null."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64)).cast("int")


def process_name(path: Column) -> Column:
    """A title from a file name: no download noise, numbers or identifiers, words capitalised."""
    stem = F.regexp_replace(F.regexp_extract(text_of(path), r"([^/]*)$", 1), r"\.[^.]*$", "")
    words = F.split(F.lower(F.regexp_replace(stem, "[_-]+", " ")), " +")
    drop = lambda w: w.rlike(r"^(|video|recording|screen|download|downloaded|\d{3,4}p|\d{2,})$") | (w.rlike(r"[a-z]") & w.rlike(r"\d") & (F.length(w) >= 8))
    name = F.array_join(F.transform(F.filter(words, lambda w: ~drop(w)), F.initcap), " ")
    return F.when(name == "", "Recorded Process").otherwise(name)


# Terms that name what a screen shows.
KEY_TERMS = r"\b(pivottable|pivot\s+table|pivotchart|pivot\s+chart|slicer|fields?|rows?|columns?|values?|measure|percentage|sum|maximum|chart|filter|dialog|table|worksheet|export|submit|save)\b"


def key_terms(x: Column, most: int = 18) -> Column:
    """The first distinct key terms in order."""
    return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text_of(x)), F.lit(KEY_TERMS), F.lit(1)))), 1, most)


def state_signature(system: Column, image_hash: Column, x: Column) -> Column:
    return F.concat_ws(":", system, F.substring(image_hash, 1, 8), F.array_join(F.slice(F.array_sort(tokens(x)), 1, 10), " "))


def event_signature(system: Column, x: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", system, F.lower(F.substring(text_of(x), 1, 500)))), 1, 12)


def confidence_reason(confidence: Column, risky: Column, text_delta: Column, visual: Column) -> Column:
    """Why a step isn't certain, joined in order."""
    why = [(confidence != "high", "confidence is not high"), (risky, "contains a specific action or value"), (text_delta > 0.6, "text changed strongly"), (visual < 0.04, "little visual change")]
    return F.concat_ws("; ", *[F.when(cond, reason) for cond, reason in why])


def parsed_items(x: Column, schema: str) -> Column:
    """The JSON array in a model's answer, with or without a code fence, as an array of structs."""
    return F.from_json(F.regexp_extract(text_of(x), r"(?s)(\[.*\])", 1), f"array<{schema}>")


def holds(conditions: list[tuple[str, str, list[str]]], columns: dict[str, Column]) -> Column:
    """Whether all of a rule's conditions hold: (column, has or lacks, terms)."""
    parts = [contains_any(columns[c], terms) if op == "has" else ~contains_any(columns[c], terms) for c, op, terms in conditions]
    return reduce(lambda a, b: a & b, parts)


def first_rule(table: list, columns: dict[str, Column]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return F.coalesce(*[F.when(holds(conditions, columns), name) for name, conditions in table])
