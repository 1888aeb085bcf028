"""Names and search: normalisation, match scores, cleaning, escaping. All are Column expressions without UDFs."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import functions as F

#: White space as browsers know it, for a Java character class.
SPACES = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Letters that decomposition leaves whole, and what stands for them.
SPECIAL_LETTERS = {
    "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ð": "d", "Ð": "D", "þ": "th", "Þ": "TH", "æ": "ae", "Æ": "AE", "œ": "oe",
    "Œ": "OE", "ß": "ss", "đ": "d", "Đ": "D", "ħ": "h", "Ħ": "H", "ı": "i", "İ": "I", "ĳ": "ij", "Ĳ": "IJ",
}
# Endings of station names, in the order in which they go; an entry may need white space before it.
GLUED_ENDINGS = ["hauptbahnhof", "treinstation", "spoorwegstation", "turiststation", "jernbanestation", "bahnhof", "bergstation", "talstation", "haltepunkt"]
SPACED_ENDINGS = [["Railway", "Station"], ["Train", "Station"], ["Railway"], ["Station"], ["Halt"], ["Gare"], ["Estaci[oó]n"], ["Stazione"], ["Esta[cç][aã]o"]]
EXACT_ENDINGS = ["駅", "站", "火车站"]


def _bare(c: str) -> str:
    """A character's full canonical decomposition without the marks that searches leave out."""
    return "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)


def _letters():
    """Letters whose bare form is one other letter, and those letters; letters with any other bare form, and those forms.

    Hangul syllables are left out: their parts follow from their code points.
    """
    one, other = [], []
    for c in map(chr, range(sys.maxunicode + 1)):
        if not 0xD800 <= ord(c) <= 0xDFFF and not 0xAC00 <= ord(c) <= 0xD7A3 and c not in SPECIAL_LETTERS and _bare(c) != c:
            (one if len(_bare(c)) == 1 else other).append((c, _bare(c)))
    return one, other


def _marks() -> list[tuple[str, int]]:
    """Marks that decomposition puts in canonical order and that searches keep, with their classes."""
    return [(c, unicodedata.combining(c)) for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c) and _bare(c) == c]


def _char_class(chars) -> str:
    """The characters as ranges inside a Java character class."""
    codes, out = sorted(map(ord, chars)), []
    for k in codes:
        if out and out[-1][1] == k - 1:
            out[-1][1] = k
        else:
            out.append([k, k])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


_ONE, _OTHER = _letters()
_ACCENTED, _BARE = ("".join(x) for x in zip(*_ONE, strict=True))
_MARKS = _marks()
_MARK_CLASS = _char_class(c for c, _ in _MARKS)
_SYLLABLE = r"\x{ac00}-\x{d7a3}"


def _list(items):
    """A constant array of strings, none of which holds a line feed."""
    return F.split(F.lit("\n".join(items)), "\n")


def _jamo(first: int, n: int):
    return _list(chr(first + k) for k in range(n))


def _spelt_out(c):
    """One character as its parts, where it is a Hangul syllable or a letter whose bare form is not one letter."""
    k = F.ascii(c) - 0xAC00
    tail = F.when(k % 28 != 0, F.element_at(_jamo(0x11A8, 27), (k % 28).cast("int"))).otherwise("")
    syllable = F.concat(F.element_at(_jamo(0x1100, 19), (F.floor(k / 588) + 1).cast("int")), F.element_at(_jamo(0x1161, 21), (F.floor(k % 588 / 28) + 1).cast("int")), tail)
    at = F.position(c, F.lit("".join(a for a, _ in _OTHER)))
    listed = F.element_at(_list(b for _, b in _OTHER), at)
    return F.when((k >= 0) & (k < 11172), syllable).when((c != "") & (at > 0), listed).otherwise(c)


def _mark_order(run):
    """A run of marks in canonical order: by class, those of one class as they stood."""
    kind = lambda c: F.element_at(_list(str(k) for _, k in _MARKS).cast("array<int>"), F.position(c, F.lit("".join(m for m, _ in _MARKS))))
    marks = F.array_sort(F.transform(F.split(run, ""), lambda c, i: F.struct(kind(c).alias("kind"), i.alias("i"), c.alias("c"))))
    return F.array_join(F.transform(marks, lambda x: x["c"]), "")


#: Latin, Greek and Cyrillic letters and common punctuation: nothing but letters of one base letter.
_PLAIN = r"\x{0}-\x{482}\x{1e00}-\x{20cf}"
#: Stretches of 256 characters that hold marks, syllables or letters of several parts.
_BLOCKS = _char_class(chr(k) for b in sorted({ord(c) >> 8 for c in [*(a for a, _ in _OTHER), *(c for c, _ in _MARKS)]}) for k in range(b << 8, (b + 1) << 8)) + _SYLLABLE


def decomposed(text):
    """``text`` in full canonical decomposition, without the marks U+0300 to U+036F.

    Letters with one base letter are translated, and most texts have no others. Texts that hold characters of other
    blocks are looked at again: Hangul and letters of several parts are spelt out, other marks in a row are put in order.
    """
    plain = F.regexp_replace(F.translate(text, _ACCENTED, _BARE), r"[\u0300-\u036f]", "")
    spelt = F.array_join(F.transform(F.split(plain, ""), _spelt_out), "")
    runs = F.regexp_extract_all(spelt, F.lit(f"([{_MARK_CLASS}]+|[^{_MARK_CLASS}]+)"), F.lit(1))
    ordered = F.array_join(F.transform(runs, lambda r: F.when(F.rlike(r, F.lit(f"^[{_MARK_CLASS}]{{2}}")), _mark_order(r)).otherwise(r)), "")
    return F.when(F.rlike(text, F.lit(rf"\A[{_PLAIN}]*\z")), plain).when(~F.rlike(text, F.lit(f"[{_BLOCKS}]")), plain).otherwise(ordered)


def normalize_for_search(text):
    """Diacritics stripped, special letters spelt out, lower case. İ becomes i, capital ẞ stays ß. Null stays null."""
    single = {a: b for a, b in SPECIAL_LETTERS.items() if len(b) == 1}
    out = decomposed(F.translate(text, "İ" + "".join(single), "I" + "".join(single.values())))
    for letter, stands in SPECIAL_LETTERS.items():
        if letter not in single and letter != "İ":
            out = F.replace(out, F.lit(letter), F.lit(stands))
    return F.lower(out)


def search_words(text, least: int):
    """The words of a normalised string with ``least`` letters or more."""
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: F.length(w) >= least)


def word_score(q, t):
    """70 to 0 for a word of a query and one of a target: equal, prefix, inside, one or two edits."""
    near = (F.length(q) >= 3) & (F.length(t) >= 3) & (F.abs(F.length(q) - F.length(t)) <= 2)
    edits = F.levenshtein(q, t, 2)
    typo = F.when(near & (edits == 1), 40).when(near & (edits == 2), 30)
    return F.when(q == t, 70).when(F.startswith(t, q), 60).when(F.contains(t, q), 50).otherwise(F.coalesce(typo, F.lit(0)))


def fuzzy_match_score(query, target):
    """0 to 100 for two normalised strings: whole equal, prefix, inside; then the best pair of their words."""
    pairs = F.transform(search_words(query, 2), lambda q: F.transform(search_words(target, 1), lambda t: word_score(q, t)))
    best = F.array_max(F.flatten(pairs))
    some = (F.coalesce(query, F.lit("")) != "") & (F.coalesce(target, F.lit("")) != "")
    ladder = F.when(query == target, 100).when(F.startswith(target, query), 90).when(F.contains(target, query), 80).otherwise(F.coalesce(best, F.lit(0)))
    return F.when(some, ladder).otherwise(0)


def clean_station_name(name):
    """A station name without its kind of station, each ending tried once in order, white space collapsed."""
    out = name
    for ending in GLUED_ENDINGS:
        out = F.regexp_replace(out, f"(?iu){ending}$", "")
    for words in SPACED_ENDINGS:
        out = F.regexp_replace(out, "(?iu)" + "".join(f"[{SPACES}]+{w}" for w in words) + "$", "")
    for ending in EXACT_ENDINGS:
        out = F.regexp_replace(out, f"{ending}$", "")
    return F.regexp_replace(F.regexp_replace(out, f"[{SPACES}]+", " "), "^ | $", "")


def escape_html(text):
    out = text
    for a, b in {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def uri_component(text):
    """Percent encoding in which a space is %20 and ! ' ( ) ~ stay."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}.items():
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def format_count(n):
    return F.format_number(n, 0)


def request_key(name, lat, lng):
    """Lower-cased ``name|lat,lng``; missing parts are empty."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.lower(F.concat(part(name), F.lit("|"), part(lat), F.lit(","), part(lng)))


def matches_any(text, patterns):
    """Whether any of the patterns occurs, whatever the case; null is no match."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(F.rlike(text, F.lit("(?i)" + p)), F.lit(False))
    return out
