"""Text clean-up, fuzzy tokens, field values and the noise grade of a value.

Everything is a Column builder over built-in functions, so a projection that
cleans a page or grades a value stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credence.functions.arrays import first_match

LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"

#: White space as ``(?U)\s`` has it, and what parts two lines once their ends are trimmed.
#: Looking first whether a character is printable ASCII spares most of them the long class.
WHITE = r"[\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
LINE_GAP = r"(?=[^!-~])" + WHITE + r"*[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]" + WHITE + "*"

WHITE_CHARACTERS = "\t\n\x0B\x0C\r \x85\xA0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000"
#: Line breaks below U+0080 other than the line feed, one by one: a class without ranges is one look-up.
ODD_BREAK = r"[\r\x0B\x0C\x1C\x1D\x1E]"

# Characters peeled off line ends, captions and values.
LEADING_NOISE = r"[ \t|/\\,.;:!?\-–—_=+~^*]+"
TRAILING_NOISE = r"[ \t|/\\,;:!?\-–—_=+~^*]+"
CAPTION_SEPARATORS = r"[ \t:.\-–—/()|,]"
VALUE_EDGE = " :.-–—"
TOKEN_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_CHARACTERS))


def squish(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def title_case(text: Column) -> Column:
    """A capital after every non-letter: LAPU-LAPU -> Lapu-Lapu, O'BRIEN -> O'Brien."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def canonical_city(city: Column) -> Column:
    """Squished and title-cased; blank gives NULL."""
    return F.nullif(title_case(squish(city)), F.lit(""))


def city_key(city: Column) -> Column:
    """Lower-case city without a leading 'city of'."""
    return F.lower(F.trim(F.regexp_replace(F.trim(city), r"(?i)^city of\s+", "")))


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def clean_lines(text: Column) -> Column:
    """Lines with inner blanks collapsed and ends trimmed, blank lines dropped. Patterns
    pass over the whole text: one call for each line costs several times as much. ASCII
    text with line feeds only has two kinds of white space left once blanks are collapsed,
    which plain replacements deal with."""
    single = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")
    plain = F.trim(F.replace(F.replace(single, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")))
    odd = (F.length(text) != F.octet_length(text)) | text.rlike(ODD_BREAK)
    return F.array_remove(F.when(odd, F.split(strip(single), LINE_GAP)).otherwise(F.split(plain, "\n")), "")


def clean_text(text: Column) -> Column:
    return F.array_join(clean_lines(text), "\n")


def _tidy_line(line: Column) -> Column:
    line = strip(F.regexp_replace(line, r"[ \t]+", " "))
    line = F.regexp_replace(line, r"\s+([,.;:!?])", "$1")
    line = F.regexp_replace(line, r"([,.;:!?\-])\1+", "$1")
    line = F.regexp_replace(line, "^" + LEADING_NOISE, "")
    line = F.regexp_replace(line, TRAILING_NOISE + "$", "")
    return strip(F.regexp_replace(line, r"\s+", " "))


def tidy_text(text: Column) -> Column:
    """Readable form of a noisy page; for display only, never for extraction."""
    lines = F.transform(split_lines(text), _tidy_line)
    return F.array_join(F.filter(lines, lambda x: x.rlike(r"[A-Za-z0-9]{2,}")), "\n")


def norm_token(word: Column) -> Column:
    return F.regexp_replace(F.upper(word), r"[^A-Z0-9]", "")


def fuzzy_token_eq(a: Column, b: Column | str, max_typos: int = 0, normalised: bool = False) -> Column:
    """Equal within max_typos edits, capped one below the shorter token. Lengths
    are compared first, so the edit distance runs on few tokens only."""
    left = a if normalised else norm_token(a)
    if isinstance(b, str):
        plain = "".join(ch for ch in b.upper() if ch in TOKEN_CHARACTERS)
        right, size = F.lit(plain), F.lit(len(plain))
    else:
        right = norm_token(b)
        size = F.length(right)
    both = (left != "") & (right != "")
    if max_typos < 1:
        return both & (left == right)
    tolerance = F.least(F.lit(max_typos), F.length(left) - 1, size - 1)
    comparable = (tolerance >= 1) & (F.abs(F.length(left) - size) <= max_typos)
    return both & ((left == right) | (comparable & (F.levenshtein(left, right) <= tolerance)))


def one_typo(word: str) -> str:
    """Pattern of the words, between blanks, that are at most one edit from ``word``."""
    cuts = range(len(word))
    near = [f"{word[:i]}[A-Z0-9]?{word[i + 1:]}" for i in cuts] + [f"{word[:i]}[A-Z0-9]{word[i:]}" for i in (*cuts, len(word))]
    return rf"(?<![^ ])(?:{'|'.join(near)})(?![^ ])"


def escape_regex(text: str) -> str:
    """Quote a plain caption for use inside a pattern."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}-" else ch for ch in text)


def strip_leading_captions(text: Column, labels: list[str]) -> Column:
    """Drop separators and repeated captions from the front of a value."""
    alternatives = "|".join([CAPTION_SEPARATORS + "+"] + [escape_regex(label) for label in labels])
    return strip(F.regexp_replace(text, f"(?i)^(?:{alternatives})*+", ""))


def value_edges(value: Column) -> Column:
    """A value without the separators around it."""
    return strip(F.btrim(value, F.lit(VALUE_EDGE)))


def shaped_value(key: str, edges: Column) -> Column:
    """A value without separators around it in the form of its field."""
    if key == "tin":
        digits = F.regexp_replace(edges, r"\D", "")
        grouped = F.regexp_replace(digits, r"^(\d{3})(\d{3})(\d{3})(\d{1,4}).*$", "$1-$2-$3-$4")
        return F.when(F.length(digits) >= 12, grouped).otherwise(edges)
    if key == "date_issued":
        return F.regexp_replace(edges, r"\s+", " ")
    return edges


def normalise_value(key: str, value: Column) -> Column:
    """Final form of one field value."""
    return shaped_value(key, value_edges(value))


# Thresholds of the noise grade.
NOISE_MIN_LENGTH = 3
NOISE_SYMBOL_RATIO = 0.15
NOISE_CONSONANT_RUN = 5
GARBLE = r"[|~^\\_«»§¢£¥°¬{}\[\]<>*+=@]"
PLAUSIBLE = r"[A-Za-z0-9 .,&/'#()\-]"


def looks_noisy(value: Column) -> Column:
    """Whether a free-text value has the shapes of a misread scan."""
    text = strip(value)
    tokens = F.split(text, r"(?U)\s+")
    odd = F.length(F.regexp_replace(text, PLAUSIBLE, ""))
    lone_letters = F.regexp_count(text, F.lit(r"(?U)(?<![\w.])[A-Za-z](?![\w.])"))
    letters = lambda t: F.regexp_replace(t, r"\P{L}", "")
    short_caps = F.exists(tokens, lambda t: letters(t).rlike(r"^\p{Lu}{1,2}$"))
    fused = F.exists(tokens, lambda t: (F.length(t) > 4) & t.rlike(r"[A-Za-z]\d|\d[A-Za-z]"))
    hard_to_say = F.exists(tokens, lambda t: (F.length(F.upper(letters(t))) >= 4) & (
        ~F.upper(letters(t)).rlike("[AEIOUY]")
        | F.upper(letters(t)).rlike("[^AEIOUY]{%d}" % NOISE_CONSONANT_RUN)))
    return (
        (F.length(text) < NOISE_MIN_LENGTH)
        | text.rlike(GARBLE)
        | (odd / F.length(text) > NOISE_SYMBOL_RATIO)
        | (lone_letters > 1)
        | (text.rlike(r"\p{Ll}") & short_caps)
        | fused
        | hard_to_say
    )


def keywords_found(text: Column, keywords: list[str]) -> Column:
    """The template keywords present anywhere in the text, in list order."""
    upper = F.upper(text)
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(upper, k))


def label_slug(label: Column) -> Column:
    """Free-typed caption to snake_case key."""
    slug = F.regexp_replace(F.lower(F.trim(label)), r"[^a-z0-9]+", "_")
    return F.regexp_replace(slug, r"^_+|_+$", "")


def first_line_with(lines: Column, labels: list[str]) -> Column:
    """Position of the first line (upper-cased lines) holding any caption."""
    def holds(line: Column) -> Column:
        hit = F.lit(False)
        for label in labels:
            hit = hit | line.contains(label)
        return hit
    return first_match(lines, holds)
