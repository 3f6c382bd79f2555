"""Text rewriting as ordered lists of rules over columns. A rule is a pattern and its replacement (groups as \\1)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str]

# Patterns and replacements, in the order in which they apply.
TIDY: list[Rule] = [(r"^\s+", ""), (r"\s+$", ""), (r"\s+", " ")]
NORMALIZE_TEXT: list[Rule] = [(r"\\r", " "), (r"\\n", " "), (r"<[a-z].*?>", " "), (r"</[a-z].*?>", " "), (r"<[a-z].*?/>", " "), (r"\s+", " ")]
REMOVE_MARKUP: list[Rule] = [
    (r"<\S+>", " "),
    (r"https?://?\s*\S+\s", " "),
    (r"https?://?\s*\S+$", ""),
    (r"\(https?:\\\S+\)", " "),
    (r"\(?www\.\S+\)?", " "),
    (r"\[ID:[^\]]+\]", " "),
    (r"\[id:[^\]]+\]", " "),
    (r"\(PDF\)", " "),
    (r"&mdash;", " "),
    (r"&quot;", " "),
    (r"&#39;", " "),
    *TIDY,
]
REMOVE_NUMBERS: list[Rule] = [(r"[0-9,]+", " ")]
REMOVE_CAPS: list[Rule] = [(r"[A-Z]\S*", " ")]
REMOVE_NONSENTENTIAL_PUNCT: list[Rule] = [
    (r"^-+", ""), (r"--+", ""), (r"\s-+", ""), (r"^-(\s+)", r"\1"), (r"\s-(\S+)", r" \1"),
    (r"~", " "),
    (r'"', ""),
    (r"^'+", ""), (r"'+$", ""), (r"'+\s+", " "), (r"\s+'+", " "), (r"\s+`+", " "), (r"^`+", " "),
    (r"\((\S+)", r"\1"), (r"(\S+)\)", r"\1"),
    (r":\s", " "), (r":$", ""), (r";\s", " "), (r";$", ""),
    (r"_+\s", " "), (r"^_+", ""), (r"_+$", ""), (r"__+", " "),
    (r",+([A-Za-z])", r" \1"), (r",+$", " "), (r",\.\s", " "), (r",\s", " "),
    (r"\s\*+", " "), (r"\*+\s", " "), (r"\*\.", " "), (r"\s\*+\s", " "), (r"^\*+", ""), (r"\*+$", ""),
    (r"\?[!?]+", r"\\? "), (r"![?!]+", r"\\! "), (r"\.\.+", r"\\. "),
    (r"\s/", " "), (r"/\s", " "),
    (r"[!?]+\s*$", ""),
    (r"\|", " "), (r"\\", " "),
    *TIDY,
]
REMOVE_ISOLATED_SYMBOLS: list[Rule] = [(r"\s[$.:\-()=/\\<>@\s]+\s", " "), (r"^[$.:\-()=/\\<>@\s]+\s", " "), (r"\s[$.:\-()=/\\<>@\s]+$", " ")]
REMOVE_WORD_PUNCT: list[Rule] = [(r"^(\S+)[.!?]", r"\1 "), (r"\s(\S+)[.!?]", r" \1 "), (r"(\S+)[.!?]$", r"\1"), (r"\s[.!?]\s", " "), (r"^[.!?]$", ""), *TIDY]
REMOVE_TWITTER_META: list[Rule] = [(r"#\S+", " "), (r"@\S+", " "), (r"\sRT\s", " "), (r"^RT\s", " "), *TIDY]
REMOVE_PUNCTUATION: list[Rule] = [(r'[-,?!":;.()]', "")]
PUNCT_TO_SPACE: list[Rule] = [(r'[-,?!":;.()]', " ")]
#: A break after each sentence end before a space, and after an end inside quotes.
SENTENCE_BREAKS: list[Rule] = [(r"\. ", ".\n"), (r"\? ", "?\n"), (r"! ", "!\n"), (r'\."', '."\n')]

#: The same replacements for patterns that would look at a run again from each of its places: here a match starts where its
#: run does and gives nothing back, or looks at one character alone. tests/test_runs.py compares both.
LINEAR: dict[str, Rule] = {
    r"(\S+)\)": (r"(?<=\S)\)(?=[^\s)]*+(?:\s|\z))", ""),
    r"(\S+)[.!?]$": (r"(?<=\S)[.!?]$", ""),
    r"[!?]+\s*$": (r"(?<![!?])[!?]++\s*$", ""),
    r",+([A-Za-z])": (r"(?<!,),++([A-Za-z])", r" \1"),
    **{rf"{x}+$": (rf"(?<!{x}){x}++$", to) for x, to in (("'", ""), ("_", ""), (",", " "), (r"\*", ""))},
    **{rf"{x}+{after}": (rf"(?<!{x}){x}++{after}", " ") for x, after in (("'", r"\s+"), ("_", r"\s"), (r"\*", r"\s"), (r"\s", "'+"), (r"\s", "`+"))},
}
_SPACE = " \t\n\x0b\f\r"

# Characters that do not follow the rule of ascii_fold.
WORDS_FOR = {
    "\u00a2": " cents ", "\u00a3": " pounds ", "\u00a5": " yen ", "\u00b0": " degrees ", "\u00b1": " plus-or-minus ", "\u00b5": " micro ",
    "\u00bc": " 1/4 ", "\u00bd": " 1/2 ", "\u00be": " 3/4 ", "\u00f7": " divided by ", "\u03a9": " omega ", "\u03b2": " beta ", "\u03bc": " mu ",
    "\u03c0": " pi ", "\u20ac": " euros ", "\u2154": "2/3",
}
LETTERS_FOR = {
    "\u00c6": "AE", "\u00e6": "ae", "\u0152": "oe", "\u0153": "oe", "\u0184": "b", "\u0185": "b", "\u0189": "D", "\u018b": "d", "\u0196": "I", "\u00df": "ss", "\u00d0": "Th", "\u00de": "Th", "\u00f0": "th", "\u00fe": "th", "\u00d7": "x",
    "\u00d8": "O", "\u00f8": "o", "\u0110": "D", "\u0111": "d", "\u0126": "H", "\u0127": "h", "\u0131": "i", "\u0138": "k", "\u013f": "L", "\u0141": "L", "\u0140": "l", "\u0142": "l",
    "\u0149": "n", "\u014a": "N", "\u014b": "n", "\u0166": "T", "\u0167": "t", "\u0195": "hv", "\u0226": "a", "\u0227": "a", "\u0391": "A", "\u03a4": "T", "\u0441": "c", "\u1f7b": "u",
    "\u00b4": "'", "\u2018": "'", "\u2019": "'", "\u2032": "'", "\u2010": "-", "\u2011": "-", "\u2212": "-", "\u2029": "\n",
}
SPACE_FOR = "\u00aa\u00ba\u00b2\u00b3\u00b9\u2116\u2122\u203c\u2047\u2048\u2049\u2024\u2025\u2026\u018d\u018e\u018f\u0194\u019b\u019c"
DOMAIN = [(0xA0, 0x19F), (0x226, 0x227), (0x391, 0x391), (0x3A4, 0x3A4), (0x3A9, 0x3A9), (0x3B2, 0x3B2), (0x3BC, 0x3BC), (0x3C0, 0x3C0), (0x441, 0x441), (0x1E25, 0x1E25), (0x1ECB, 0x1ECB), (0x1F7B, 0x1F7B), (0x2000, 0x206F), (0x20AC, 0x20AC), (0x2116, 0x2116), (0x2122, 0x2122), (0x2154, 0x2154), (0x2212, 0x2212), (0xFB01, 0xFB01)]


def folding() -> dict[str, str]:
    """ASCII for the characters of DOMAIN that have any: exceptions, then what is left of the compatibility decomposition
    without combining marks; the row U+0180-U+019F takes the letter of its Unicode name."""
    out: dict[str, str] = {}
    for low, high in DOMAIN:
        for c in map(chr, range(low, high + 1)):
            if c in SPACE_FOR:
                continue
            plain = WORDS_FOR.get(c) or LETTERS_FOR.get(c)
            if plain is None:
                plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if not plain.isascii() and 0x180 <= ord(c) <= 0x19F and (m := re.search(r"(SMALL|CAPITAL) LETTER (?:REVERSED |TURNED |OPEN )?([A-Z])\b", unicodedata.name(c, ""))):
                plain = m[2] if m[1] == "CAPITAL" else m[2].lower()
            if plain and plain.isascii():
                out[c] = plain
    return out


def java_replacement(s: str) -> str:
    """Groups are $1 in Java; a doubled backslash stays one literal backslash."""
    return re.sub(r"\\(\d)", r"$\1", s)


def apply(column: Column, rules: Sequence[Rule]) -> Column:
    """The rules one after the other, each in time that grows with the text."""
    for pattern, replacement in rules:
        if not replacement and pattern in (r"^\s+", r"\s+$"):
            column = (F.ltrim if pattern.startswith("^") else F.rtrim)(column, F.lit(_SPACE))
            continue
        pattern, replacement = LINEAR.get(pattern, (pattern, replacement))
        column = F.regexp_replace(column, F.lit(pattern), F.lit(java_replacement(replacement)))
    return column


def rewriter(rules: Sequence[Rule]) -> Callable[[Column], Column]:
    return lambda column: apply(column, rules)


normalize_text = rewriter(NORMALIZE_TEXT)
remove_markup = rewriter(REMOVE_MARKUP)
remove_numbers = rewriter(REMOVE_NUMBERS)
remove_caps = rewriter(REMOVE_CAPS)
remove_nonsentential_punct = rewriter(REMOVE_NONSENTENTIAL_PUNCT)
remove_isolated_symbols = rewriter(REMOVE_ISOLATED_SYMBOLS)
remove_word_punct = rewriter(REMOVE_WORD_PUNCT)
remove_twitter_meta = rewriter(REMOVE_TWITTER_META)
remove_punctuation = rewriter(REMOVE_PUNCTUATION)
punct_to_space = rewriter(PUNCT_TO_SPACE)

FOLD_TAIL: list[Rule] = [*TIDY, (r"\s+.$", ".")]


def ascii_fold(column: Column) -> Column:
    """Characters to ASCII, others to a space, then tidied; a final token of one character becomes a full stop. The column is
    named once, so a chain of steps is not evaluated again for each."""
    table = folding()
    folded = column
    for c, s in table.items():
        if len(s) > 1:
            folded = F.replace(folded, F.lit(c), F.lit(s))
    single = {c: s for c, s in table.items() if len(s) == 1}
    folded = F.translate(folded, "".join(single), "".join(single.values()))
    folded = F.regexp_replace(folded, r"[^\x00-\x7E]", " ")
    return apply(folded, FOLD_TAIL)


#: The topic normalisation, step by step: any list of Column -> Column may stand in its place.
TOPIC_STEPS: list[Callable[[Column], Column]] = [ascii_fold, remove_markup, remove_numbers, remove_nonsentential_punct, remove_caps, remove_isolated_symbols, rewriter([(r"\s+", " ")])]


def normalize_topic(column: Column, steps: Sequence[Callable[[Column], Column]] = TOPIC_STEPS) -> Column:
    for step in steps:
        column = step(column)
    return apply(column, [(r"\A \z", "")])


def sentences(column: Column) -> Column:
    parts = F.split(apply(column, SENTENCE_BREAKS), "\n")
    trimmed = F.transform(parts, lambda s: F.btrim(s, F.lit(_SPACE)))
    return F.filter(trimmed, lambda s: s != "")


def tokens(column: Column) -> Column:
    """Words of the sentences, without the punctuation that ends them."""
    cleaned = F.filter(F.transform(sentences(column), remove_word_punct), lambda s: (s != "") & (s != " "))
    return F.flatten(F.transform(cleaned, lambda s: F.split(s, " ")))


def alpha_tokens(column: Column) -> Column:
    """Lower-case runs of a-z; the tokenizer of the oracle-checked models."""
    return F.filter(F.split(F.lower(column), "[^a-z]+"), lambda t: t != "")


def split_string(column: Column, delimiters: str = "[ \n\r\t]+") -> Column:
    """Parts between runs of delimiters, none empty; null if there are none."""
    parts = F.filter(F.split(column, delimiters), lambda t: t != "")
    return F.when(F.size(parts) > 0, parts)


def word_units(term: Column) -> Column:
    """Units of a term joined by underscores."""
    return F.size(F.filter(F.split(term, "_"), lambda t: t != ""))


def unit_substring(a: Column, b: Column) -> Column:
    """1 if b is inside a in whole units, -1 if a is inside b, else 0; equal lengths give 0."""
    inside = lambda x, y: F.instr(F.concat(F.lit("_"), x, F.lit("_")), F.concat(F.lit("_"), y, F.lit("_"))) > 0
    return F.when((F.length(a) > F.length(b)) & inside(a, b), 1).when((F.length(a) < F.length(b)) & inside(b, a), -1).otherwise(0)
