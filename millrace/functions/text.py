"""Text columns: line ends, HTML to text, entities, lexical terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named HTML entities that are decoded; ``amp`` comes last so that nothing is decoded twice.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "bull": "•", "middot": "·", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "times": "×", "divide": "÷", "laquo": "«", "raquo": "»", "shy": "­", "ensp": " ", "emsp": " ", "thinsp": " ", "zwnj": "‌",
    "zwj": "‍", "lrm": "‎", "rlm": "‏", "eacute": "é", "Eacute": "É", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "amp": "&",
}
# Tags that end a line of text, and those whose content is never text.
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|tr|ul"
HIDDEN = ("head", "script", "style", "template")
# Possessive throughout: Java's matcher recurses once for each step of a group that might have to be tried again.
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_END = "(?![A-Za-z0-9:-])"
_TAG = rf"</?[A-Za-z0-9:-]++{_INSIDE}>"
_COMMENT = r"<!(?=--)(?s:.*?)-->"
_DECLARATION = r"""<(?:\?|!(?!--))(?:[^>"'\[\]]++|"[^"]*+"|'[^']*+'|\[(?:[^\["'\]]++|"[^"]*+"|'[^']*+'|\[[^\]]*+\])*+\]|\])*+>"""
_RAW = rf"<(script|style){_END}{_INSIDE}(?<!/)>(?s:.*?)(?:</\1(?=[\s/>]){_INSIDE}>|\z)"
_HIDDEN = rf"(?i)<(head|template){_END}{_INSIDE}(?<!/)>(?:[^<]++|<(?!/?(?:head|template)[\s/>]))*+</\1{_END}{_INSIDE}>"
_HIDDEN_TAG = rf"(?i)<(/?)(head|template){_END}{_INSIDE}>"
_PRE = rf"(?is)<pre{_END}{_INSIDE}>(.*?)(?:</pre{_END}{_INSIDE}>|\z)"
_PRE_IN_PRE = rf"(?i)<pre{_END}{_INSIDE}>(?:[^<]++|<(?!/?pre[\s/>]))*+<pre{_END}"
# Stand-ins while a page is read: ends of a preformatted part; its space, line end and tab; the end of a line and of a cell.
_CUT, _SPACE, _LINE, _TAB, _BLOCK, _CELL = "\x01", "\x02", "\x03", "\x04", "\x06", "\x07"
# Stand-ins for tags that nest: where a head, a template or a preformatted part opens, and where it closes.
_OPENS, _CLOSES = "\x0e\x0f", "\x10\x11"
_RESERVED = _CUT + _SPACE + _LINE + _TAB + _BLOCK + _CELL + _OPENS + _CLOSES


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def decode_entities(text: Column) -> Column:
    """Named entities of the table and decimal or hexadecimal references; unknown ones and &#0; stay as they are."""
    references = F.array_distinct(F.regexp_extract_all(text, F.lit("(&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});)"), 1))

    def decoded(t: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, "^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        fine = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF) & (code != 38)
        return F.when(fine, F.replace(t, ref, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise(t)  # big-endian without a mark

    out = F.when(F.size(references) > 0, F.aggregate(references, text, decoded)).otherwise(text)
    for name, value in ENTITIES.items():
        if name == "amp":
            out = F.regexp_replace(out, "&#(?:0{0,5}38|[xX]0{0,4}26);", "&amp;")
        out = F.replace(out, F.lit(f"&{name};"), F.lit(value))
    return out


def _html_piece(piece: Column, preformatted: Column) -> Column:
    t = F.regexp_replace(piece, rf"(?i)</?(?:{BLOCKS}){_END}{_INSIDE}>", _BLOCK)
    t = F.regexp_replace(F.regexp_replace(t, rf"(?i)</t[dh]{_END}{_INSIDE}>", _CELL), _TAG, "")
    t = F.when(F.contains(piece, F.lit("&")), decode_entities(t)).otherwise(t)
    return F.when(preformatted, F.translate(normalize_newlines(t), " \n\t", _SPACE + _LINE + _TAB)).otherwise(F.regexp_replace(t, r"[\s\x{85}\p{Z}]+", " "))


def _nested(marked: Column) -> tuple[Column, Column]:
    """The pieces of a text in which every opening and closing tag stands as one of ``_OPENS`` or ``_CLOSES`` (each piece starts with one, but for the
    first), and for each piece the tags that are open there, as a string of openings. A closing tag ends the innermost open element if that is of
    its kind, and nothing else.

    One pass over the tags: the state is the stack, as long as the nesting is deep, and the index of stacks by piece in compact form."""
    pieces = F.regexp_extract_all(F.concat(F.lit(_CUT), marked), F.lit(f"([{_CUT}{_OPENS}{_CLOSES}][^{_OPENS}{_CLOSES}]*)"), 1)
    tags = F.transform(pieces, lambda p: F.substring(p, 1, 1))

    def step(state: Column, tag: Column) -> Column:
        stack = state["stack"]
        closes = F.translate(tag, _CLOSES, _OPENS)
        after = F.when(tag.isin(*_OPENS), F.concat(stack, tag)).when((closes != tag) & (F.right(stack, F.lit(1)) == closes), F.left(stack, F.length(stack) - 1)).otherwise(stack)
        return F.struct(after.alias("stack"), F.concat(state["depths"], F.when(stack == "", "0").otherwise("1")).alias("depths"))

    end = F.aggregate(tags, F.struct(F.lit("").alias("stack"), F.lit("").alias("depths")), step)
    inside = F.transform(F.array(end), lambda e: F.substring(F.concat(e["depths"], F.when(e["stack"] == "", "0").otherwise("1")), 2, 1 << 30))[0]
    return pieces, F.split(inside, "")


def _outside_hidden(markup: Column) -> Column:
    """Markup without heads and templates, however they nest; those that do not end hide the rest."""
    marked = F.regexp_replace(markup, rf"(?i)<(?:head|template){_END}{_INSIDE}(?<=/)>", "")
    for name, opens, closes in zip(("head", "template"), _OPENS, _CLOSES):
        marked = F.regexp_replace(F.regexp_replace(marked, rf"(?i)<{name}{_END}{_INSIDE}>", opens), rf"(?i)</{name}{_END}{_INSIDE}>", closes)
    pieces, inside = _nested(marked)
    return F.array_join(F.zip_with(pieces, inside, lambda p, i: F.when(i == "0", F.translate(p, _CUT + _OPENS + _CLOSES, "")).otherwise("")), "")


def _outermost_pre(markup: Column) -> Column:
    """Markup in which only the outermost of preformatted parts within one another have tags."""
    marked = F.regexp_replace(F.regexp_replace(markup, rf"(?i)<pre{_END}{_INSIDE}>", _OPENS[0]), rf"(?i)</pre{_END}{_INSIDE}>", _CLOSES[0])
    pieces, inside = _nested(marked)
    tagged = F.zip_with(pieces, F.zip_with(inside, F.concat(F.array(F.lit("0")), inside), lambda now, was: F.concat(was, now)), lambda p, i: F.concat(F.when(i == "01", "<pre>").when(i == "10", "</pre>").when(F.left(p, F.lit(1)) == _CUT, "").otherwise(_BLOCK), F.translate(p, _CUT + _OPENS + _CLOSES, "")))
    return F.array_join(F.filter(tagged, lambda p: p.isNotNull()), "")


def _visible(markup: Column) -> Column:
    # elements that hold no others go by one replacement, as nearly all do; only pages with more need the stack
    flat = F.regexp_replace(markup, _HIDDEN, "")
    markup = F.when(flat.rlike(_HIDDEN_TAG), _outside_hidden(flat)).otherwise(flat)
    markup = F.when(markup.rlike(_PRE_IN_PRE), _outermost_pre(markup)).otherwise(markup)
    pieces = F.split(F.regexp_replace(markup, _PRE, f"{_BLOCK}{_CUT}$1{_CUT}{_BLOCK}"), _CUT)
    out = F.array_join(F.transform(pieces, lambda p, i: _html_piece(p, i % 2 == 1)), "")
    out = F.regexp_replace(F.regexp_replace(out, f" *([{_BLOCK}{_CELL}]) *", "$1"), " +", " ")
    out = F.regexp_replace(F.regexp_replace(out, f"([{_LINE}{_BLOCK}]){_BLOCK}+", "$1"), f"([{_TAB}{_CELL}]){_CELL}+", "$1")
    return F.regexp_replace(F.translate(out, _SPACE + _LINE + _TAB + _BLOCK + _CELL, " \n\t\n\t"), r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$", "")


def html_parsed(html: Column) -> Column:
    """(text, problem) of a page: hidden content, comments, declarations and tags drop out, blocks end lines, cells end in tabs, white space
    collapses but in preformatted parts. Markup that does not end is a problem, and the text then null. A null page has neither.

    A ``<`` before anything but a name, ``!`` or ``?`` is text, and so is all of a script or style up to its own end tag."""
    clean = F.translate(html, _RESERVED, " " * len(_RESERVED))
    markup = F.regexp_replace(clean, f"(?i)(?:{_RAW}|{_COMMENT}|{_DECLARATION})|({_TAG})", "$2")

    def read(m: Column) -> Column:
        broken = F.regexp_replace(m, _TAG, _CUT).rlike("<(?:[!?]|/?[A-Za-z0-9:-])")
        return F.struct(F.when(~broken, _visible(m)).alias("text"), F.when(broken, "unterminated").alias("problem"))

    return F.transform(F.array(markup), read)[0]


def html_to_text(html: Column) -> Column:
    return html_parsed(html)["text"]


#: Most terms of a query that count.
MAX_TERMS = 64


def lexical_terms(text: Column) -> Column:
    """Lowered words without punctuation, and pairs of neighbouring CJK characters (others between them left out)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(low, r"[\s\p{P}]+"), lambda t: t != "")
    cjk = F.regexp_extract_all(low, F.lit("([\\x{3400}-\\x{9FFF}])"), 1)
    pairs = F.when(F.size(cjk) > 1, F.transform(F.sequence(F.lit(0), F.size(cjk) - 2), lambda i: F.concat(F.get(cjk, i), F.get(cjk, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_sort(F.array_distinct(F.concat(words, pairs))), 1, MAX_TERMS)


def lexical_score(terms: Column, document: Column) -> Column:
    """Share of the terms that a lowered document contains."""
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(document, t))) / F.size(terms)).otherwise(0.0)
