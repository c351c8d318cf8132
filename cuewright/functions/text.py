"""Text expressions: Column in, Column out, all inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values ---------------------------------------------------------------------------
EDGE = "\"“”‘’'()[]{}.,!?;:"
EDGE_WITHOUT_APOSTROPHE = "\"“”‘’()[]{}.,!?;:"
I_FORMS = ["i", "i'm", "i've", "i'd", "i'll", "im", "ive", "id", "ill"]
GREETING_PAIRS = [
    "hey guys", "hey everybody", "hey everyone", "hi guys", "hi everyone", "hi everybody",
    "hello everyone", "hello everybody", "hello friends",
]
GREETING_WORDS = ["hey", "hi", "hello", "wow", "yay"]
QUESTION_STARTERS = [
    "what", "what's", "whats", "why", "how", "who", "where", "when", "which", "whose", "whom",
    "is", "are", "am", "do", "does", "did", "can", "could", "would", "will", "won't", "wont",
    "shall", "should", "isn't", "isnt", "aren't", "arent", "don't", "dont", "didn't", "didnt",
    "can't", "cant", "couldn't", "couldnt", "wouldn't", "wouldnt", "wasn't", "wasnt",
    "weren't", "werent", "was", "were", "has", "have", "had",
]
WEAK_ENDINGS = [
    "a", "an", "the", "this", "that", "these", "those", "my", "your", "our", "their",
    "to", "of", "in", "on", "at", "for", "and", "or", "but", "with", "from",
]
CONJUNCTIONS = ["and", "but", "so", "then"]
SUFFIXES = ["ings", "ing", "in'", "ers", "er", "ies", "ied", "ed", "es", "s"]
CENSOR_MARK = "_"
DISCLAIMER = "Captions are not guaranteed safe. Creator review is required."
NOTE = "Competition ranking is not the same as YouTube children's-content quality. Automatic captions require creator review."
# ----------------------------------------------------------------------------------------


def any_of(c: Column, values: list[str]) -> Column:
    return c.isin(*values)


def normalize_token(c: Column) -> Column:
    """Lower case, straight apostrophes, only a-z, 0-9 and inner apostrophes."""
    plain = F.replace(F.lower(c), F.lit("’"), F.lit("'"))
    # most words are normal as they stand, and a match costs half of what lowering and replacing do
    return F.when(c.rlike(r"\A[a-z0-9]+\z"), c).otherwise(F.btrim(F.regexp_replace(plain, "[^a-z0-9']+", ""), F.lit("'")))


def normalize_phrase(c: Column) -> Column:
    """Normalised tokens of a phrase, empty ones dropped."""
    return F.array_join(F.filter(F.transform(tokens(c), normalize_token), lambda x: x != ""), " ")


def tokens(c: Column) -> Column:
    """White-space tokens."""
    return F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))


def eval_tokens(c: Column) -> Column:
    """Tokens for error rates: runs of a-z, 0-9 and apostrophes of the lower-cased text."""
    return F.regexp_extract_all(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("’"), F.lit("'")), F.lit("[a-z0-9']+"), F.lit(0))


def edge_norm(c: Column) -> Column:
    """Lower case without marks at both ends."""
    return F.btrim(F.lower(c), F.lit(EDGE))


def has_terminal(c: Column) -> Column:
    """Ends in . ! or ?, closing quotes aside."""
    return c.rlike("[.!?][\"'”’]*$")


def capitalize_token(c: Column) -> Column:
    """Upper-case the first letter, wherever it stands."""
    part = lambda k: F.regexp_extract(c, r"^(\P{L}*)(\p{L})(.*)$", k)
    return F.when(c.rlike(r"\p{L}"), F.concat(part(1), F.upper(part(2)), part(3))).otherwise(c)


def capitalize_i(c: Column) -> Column:
    """Capitalise forms of the pronoun I, leave other tokens alone."""
    core = F.lower(F.btrim(c, F.lit(EDGE_WITHOUT_APOSTROPHE)))
    return F.when(any_of(core, I_FORMS), capitalize_token(c)).otherwise(c)


def attach_terminal(c: Column, mark: Column) -> Column:
    """End a token in a sentence mark, inside closing quotes and instead of , ; or :."""
    quotes = F.regexp_extract(c, "([\"'”’)]*)$", 1)
    body = F.regexp_replace(F.regexp_replace(c, "[\"'”’)]+$", ""), "[,;:]+$", "")
    return F.when(body.rlike("[.!?]$"), F.concat(body, quotes)).otherwise(F.concat(body, mark, quotes))


_CODED = "BFPVCGJKQSXZDTLMNR"
_CODES = "111122222222334556"
_UNCODED = "AEIOUYHW"


def soundex(c: Column) -> Column:
    """Phonetic code in which no letter without a code separates equal codes."""
    letters = F.regexp_replace(F.upper(c), "[^A-Z]", "")
    code = F.translate(letters, _CODED + _UNCODED, _CODES)
    for d in "123456":
        code = F.regexp_replace(code, f"{d}+", d)
    first = F.substring(letters, 1, 1)
    code = F.when(first.rlike(f"[{_CODED}]"), F.substring(code, 2, 100)).otherwise(code)
    return F.when(letters == "", "").otherwise(F.rpad(F.concat(first, F.substring(code, 1, 3)), 4, "0"))


def phonetic_similarity(left: Column, right: Column) -> Column:
    """Edit ratio with bonuses for equal codes and first letters, of normalised tokens."""
    longest = F.greatest(F.length(left), F.length(right))
    ratio = F.lit(1.0) - F.levenshtein(left, right) / longest
    bonus = F.when(soundex(left) == soundex(right), 0.15).otherwise(0.0)
    prefix = F.when(F.substring(left, 1, 1) == F.substring(right, 1, 1), 0.1).otherwise(0.0)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio + bonus + prefix))
    return F.when(left == right, 1.0).when((left == "") | (right == ""), 0.0).otherwise(clamped)


def vocabulary_similarity(left: Column, right: Column) -> Column:
    """Edit ratio of normalised tokens; tokens of one or two letters must be equal."""
    longest = F.greatest(F.length(left), F.length(right))
    return (
        F.when((left == "") | (right == ""), 0.0)
        .when(left == right, 1.0)
        .when(longest <= 2, 0.0)
        .otherwise(F.lit(1.0) - F.levenshtein(left, right) / longest)
    )


def canonical(term: Column, sample: Column) -> Column:
    """A vocabulary term in the casing of the token that it replaces."""
    upper = (sample == F.upper(sample)) & (sample != F.lower(sample))
    head = F.substring(sample, 1, 1)
    capital = (head == F.upper(head)) & (head != F.lower(head))
    return F.when(upper, F.upper(term)).when(capital, F.concat(F.upper(F.substring(term, 1, 1)), F.substring(term, 2, F.length(term)))).otherwise(term)


def stems(token: Column) -> Column:
    """The token and what is left of it without each suffix, in the suffixes' order."""
    cut = [
        F.when(token.endswith(s) & (F.length(token) - len(s) >= 3), F.left(token, F.length(token) - len(s)))
        for s in SUFFIXES
    ]
    return F.filter(F.array(token, *cut), lambda x: x.isNotNull())


def preserve_shape(original: Column, replacement: Column) -> Column:
    """The replacement with the marks around the original and its capital letter."""
    body = F.regexp_replace(original, "^[\"'“”‘’(]+", "")
    prefix = F.left(original, F.length(original) - F.length(body))
    core = F.regexp_replace(body, "[\"'“”‘’),:;!?.]+$", "")
    suffix = F.right(body, F.length(body) - F.length(core))
    head = F.substring(core, 1, 1)
    capital = (head == F.upper(head)) & (head != F.lower(head))
    shaped = F.when(capital, F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, 2, F.length(replacement)))).otherwise(replacement)
    return F.concat(prefix, shaped, suffix)


def apply_token(text: Column, original: Column, replacement: Column) -> Column:
    """Replace the first occurrence in any case, or else the first censor mark."""
    at = F.instr(F.lower(text), F.lower(original))
    mark = F.instr(text, F.lit(CENSOR_MARK))
    cut = lambda pos, size: F.concat(F.left(text, pos - 1), replacement, F.substring(text, pos + size, F.length(text)))
    return (
        F.when(original == "", F.when(replacement != "", F.replace(text, F.lit(CENSOR_MARK), replacement)).otherwise(text))
        .when(at > 0, cut(at, F.length(original)))
        .when((mark > 0) & (replacement != ""), cut(mark, F.lit(1)))
        .otherwise(text)
    )


def collapse(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def sound_label(c: Column) -> Column:
    """``[label]`` in lower case, empty for an empty label."""
    inner = F.lower(collapse(F.btrim(F.btrim(F.coalesce(c, F.lit(""))), F.lit("[]"))))
    return F.when(inner == "", "").otherwise(F.concat(F.lit("["), inner, F.lit("]")))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def wrap_caption(text: Column, max_chars: int = 42, max_lines: int = 2) -> Column:
    """At most two lines; breaks after weak words, orphans and short first lines cost."""
    return once(collapse(text), lambda flat: F.when(F.length(flat) <= max_chars, flat).otherwise(_wrapped(flat, max_chars, max_lines)))


def _wrapped(flat: Column, max_chars: int, max_lines: int) -> Column:
    if max_lines < 2:
        return F.rtrim(F.left(flat, F.lit(max_chars)))
    return once(F.split(flat, " "), lambda words: _two_lines(flat, words, max_chars))


def _two_lines(flat: Column, words: Column, max_chars: int) -> Column:
    n = F.size(words)

    def option(i: Column) -> Column:
        first, second = F.array_join(F.slice(words, 1, i), " "), F.array_join(F.slice(words, i + 1, n - i), " ")
        last = F.lower(F.regexp_replace(F.element_at(words, i), "[.!?,;:]+$", ""))
        score = (
            F.abs(F.length(first) - F.length(second)) * F.lit(-0.5)
            - F.when(any_of(last, WEAK_ENDINGS), 20.0).otherwise(0.0)
            - F.when((n - i == 1) & (F.length(first) > max_chars * 0.55), 12.0).otherwise(0.0)
            - F.when(F.length(first) < max_chars * 0.35, 6.0).otherwise(0.0)
        )
        return F.struct(score.alias("score"), (-i).alias("at"), first.alias("a"), second.alias("b"))

    fits = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), option), lambda o: (F.length(o["a"]) <= max_chars) & (F.length(o["b"]) <= max_chars) & (-o["at"] < n))
    best = F.array_max(fits)
    head = F.left(flat, F.lit(max_chars + 1))
    space = F.length(head) - F.instr(F.reverse(head), F.lit(" "))  # 0-based; only where there is one
    has_space = (F.instr(head, F.lit(" ")) > 0) & (space > 0)
    first = F.when(has_space, F.left(flat, space)).otherwise(F.left(flat, F.lit(max_chars)))
    rest = F.when(has_space, F.substring(flat, space + 2, F.length(flat))).otherwise(F.ltrim(F.substring(flat, max_chars + 1, F.length(flat))))
    rest = F.when(F.length(rest) > max_chars, F.rtrim(F.left(rest, F.lit(max_chars)))).otherwise(rest)
    hard = F.btrim(F.concat(first, F.lit("\n"), rest), F.lit(" \n"))
    return once(best, lambda b: F.when(b.isNotNull(), F.concat(b["a"], F.lit("\n"), b["b"])).otherwise(hard))


def reading_speed(text: Column, ms: Column) -> tuple[Column, Column]:
    """Characters and words a second; a duration counts as one millisecond at least."""
    flat = collapse(text)
    seconds = F.greatest(ms, F.lit(1)) / F.lit(1000.0)
    empty = flat == ""
    return (
        F.when(empty, 0.0).otherwise(F.length(flat) / seconds),
        F.when(empty, 0.0).otherwise(F.size(F.split(flat, " ")) / seconds),
    )


def band(score: Column, high: float = 0.90, medium: float = 0.70) -> Column:
    """high, medium or low; bounds are inclusive, scores are held to 0..1."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(s >= high, "high").when(s >= medium, "medium").otherwise("low")


def format_timecode(ms: Column) -> Column:
    """HH:MM:SS,mmm; negative times are zero."""
    t = F.greatest(ms.cast("long"), F.lit(0).cast("long"))
    part = lambda by, mod: F.floor(t / by) % mod
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3_600_000), part(60_000, 60), part(1000, 60), t % 1000)


_TIMECODE = r"(-?\d+):(\d{2}):(\d{2})[,.](\d{1,3})"


def parse_timecode(c: Column, strict: bool = True) -> Column:
    """Milliseconds of a timecode with one to three fraction digits after , or ."""
    part = lambda k: F.regexp_extract(c, _TIMECODE, k).cast("long")
    fraction = F.rpad(F.regexp_extract(c, _TIMECODE, 4), 3, "0").cast("long")
    ms = part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + fraction
    bad = F.raise_error(F.concat(F.lit("malformed timecode: "), c)).cast("long") if strict else F.lit(None).cast("long")
    return F.when(c.rlike(_TIMECODE), ms).otherwise(bad)


def modal(values: Column) -> Column:
    """The most frequent value that is not null or empty; the first seen wins ties."""
    some = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    counted = F.transform(
        F.array_distinct(some),
        lambda v: F.struct(F.size(F.filter(some, lambda w: w == v)).alias("n"), (-F.array_position(some, v)).alias("at"), v.alias("v")),
    )
    return F.array_max(counted)["v"]
