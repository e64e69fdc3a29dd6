"""Tokenization and text functions as Columns: no user functions, so plans stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of ASCII letters, digits and control characters; each punctuation mark; each character beyond ASCII.
#: Every character of the runs is named, as Java looks these up in one table; of what is no white space, marks and others are left then.
TOKEN = "[" + "".join(rf"\x{c:02x}" for c in range(128) if not 9 <= c <= 13 and (c <= 31 or c == 127 or chr(c).isalnum())) + r"]+|\S"
#: The same without punctuation, which then only separates.
TOKEN_NO_PUNCT = r"[\x00-\x7F&&[^\s\p{Punct}]]+|[^\x00-\x7F]"
#: White space dropped, punctuation alone, characters beyond ASCII inside runs.
TOKEN_CHAR = r"[^\s\p{Punct}]+|\p{Punct}"
SYLLABLES = "^(?:[DGLMNSTWZbcdfghklmnprstvwyz]*[#%&()*3679AEIOQRUaeilou~]+[DGLMNSTWZbcdfghklmnprstvwyz]*){1,4}$"
#: The same words, told in one pass: l is of both kinds, so a syllable more begins only where a sure consonant stands before a sure vowel.
_L_ALIKE = {"c": "DGLMNSTWZbcdfghkmnprstvwyz", "v": "#%&()*3679AEIOQRUaeiou~"}
SYLLABLES_ONCE = "^(?:[{c}l]*+(?:[{v}][{v}l]*+(?:[{c}][{c}l]*+)?){{1,4}}|[{c}]*+l[{c}l]*+)$".format(**_L_ALIKE)
SPACES = r"[ \t\n\x0B\f\r]+"

#: The default stop words.
STOP_WORDS = """
a able about across after all almost also am among an and any are as at be because been but by can
cannot could dear did do does either else ever every for from get got had has have he her hers him
his how however i if in into is it its just least let like likely may me might most must my neither
no nor not of off often on only or other our own rather said say says she should since so some than
that the their them then there these they this tis to too twas us wants was we were what when where
which while who whom why will with would yet you your
""".split()


def ascii_lower(text: Column | str) -> Column:
    """A-Z alone are lower-cased."""
    return F.translate(text, UPPER, LOWER)


def tokens(text: Column | str, separator: str = "cjkv", lower: bool = True) -> Column:
    """The tokens of a text. ``separator``: cjkv, legacy (punctuation only separates) or char."""
    pattern = {"cjkv": TOKEN, "legacy": TOKEN_NO_PUNCT, "char": TOKEN_CHAR}[separator]
    return F.regexp_extract_all(ascii_lower(text) if lower else text, F.lit(pattern), F.lit(0))


def without_stop_words(toks: Column, stop_words=STOP_WORDS) -> Column:
    words = sorted(set(stop_words))
    return F.filter(toks, lambda t: ~t.isin(words)) if words else toks


def words(text: Column | str) -> Column:
    """White-space separated words."""
    return F.array_remove(F.split(text, SPACES), "")


def first_field(text: Column) -> Column:
    """What stands before the first blank; the whole text without one."""
    return F.substring_index(text, " ", 1)


def rest_fields(text: Column) -> Column:
    """What stands after the first blank; empty without one."""
    return F.when(F.instr(text, " ") > 0, F.substr(text, F.instr(text, " ") + 1)).otherwise("")


def strip_after(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def strip_before(text: Column, mark: str) -> Column:
    """From the first ``mark`` on; the whole text without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substr(text, at)).otherwise(text)


def is_facet_line(key: Column) -> Column:
    return key.endswith(":facet")


def renew_facet(line: Column | str) -> Column:
    """The first old-style facet element of a line in the new style."""
    return F.regexp_replace(line, r'(?s)^(.*?)<facet class="(.*?)">\s*(\S+?)</facet>', "$1<facet>$2:$3</facet>")


def syllabic(word: Column) -> Column:
    """Whether a word is one to four syllables of the phonemic alphabet."""
    return word.rlike(SYLLABLES_ONCE)


def tokenize(lines: DataFrame, text: str = "text", *, stop_list: bool = True, stem: bool = True, first_is_key: bool = False, bypass: bool = False, separator: str = "cjkv") -> DataFrame:
    """``lines`` with ``toks``: lower-cased, split, without stop words, stemmed; and ``key`` where the first field is one.

    The key keeps its case. A line without a blank is all key and has no tokens. ``bypass`` leaves the
    line as its only token. Works on streams, unless stems are asked for.
    """
    if bypass:
        return lines.withColumn("toks", F.array(F.col(text)))
    body = F.col(text)
    if first_is_key:
        lines = lines.withColumn("key", first_field(F.col(text)))
        body = rest_fields(body)
    toks = tokens(body, separator)
    lines = lines.withColumn("toks", without_stop_words(toks) if stop_list else toks)
    if stem:
        from quillforge.functions.porter import stem_tokens

        lines = stem_tokens(lines, "toks")
    return lines
