"""HTML rules as SQL expressions: titles, main text, anchors, character references."""

from __future__ import annotations

import json
from html.entities import html5

from linkspark.functions.sql import lam, let, raw, struct, text

MAX_CONTENT = 50_000  # characters of main text a page record keeps
MAX_ANCHOR_TEXT = 200

# Fixed value: elements that are not part of the main text.
BOILERPLATE_TAGS = ("script", "style", "nav", "footer", "header")

# inside a tag, quotes count after '=' only, and may hold '>'
_IN_TAG = r"(?:[^>=]++|=\s*+\x22[^\x22]*+\x22|=\s*+\x27[^\x27]*+\x27|=)*+>"
_TAG = rf"<[A-Za-z/!?]{_IN_TAG}"
_SPACE = r"(?U)[\s\x{FEFF}]+"
_EDGE_SPACE = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"
_ENDS = r"(?=[\s/>])"  # of an element's name: <nav-bar> is no <nav>
_OPEN_ANCHOR = rf"<a{_ENDS}{_IN_TAG}"
_ANCHOR = rf"(?is){_OPEN_ANCHOR}.*?(?=</a{_ENDS}|<a{_ENDS}|\z)"
# what isn't markup, whichever starts first: comments, and the text of scripts and styles
_HIDDEN = rf"(?is)<!--.*?(?:-->|\z)|<(script|style){_ENDS}{_IN_TAG}.*?(?:</\1{_ENDS}[^>]*>|\z)"
# one attribute after another, so that a quoted value is never searched for names
_ATTRIBUTE = r"(?s)[^\s=>/\x22\x27][^\s=>/]*(?:\s*=\s*(?:\x22[^\x22]*\x22|\x27[^\x27]*\x27|[^\s>]+))?"

# The standard table of named references; the map is searched in order, so frequent names lead.
_FREQUENT = ("amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "middot")
_TABLE = json.dumps({n: html5[n + ";"] for n in (
    *_FREQUENT, *(k[:-1] for k in html5 if k.endswith(";")))})
_BARE = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))
_C1 = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))


def _numeric(piece: str) -> str:
    """'#65;rest' or '#x41;rest' with the reference replaced by its character."""
    def character(p: str) -> str:
        return (f"CASE WHEN {p} = 0 OR {p} > 1114111 OR {p} BETWEEN 55296 AND 57343 THEN '\\ufffd' "
                f"WHEN {p} BETWEEN 128 AND 159 THEN substr({text(_C1)}, {p} - 127, 1) "
                f"ELSE decode(unhex(lpad(hex({p}), 8, '0')), 'UTF-32') END")

    def build(code: str) -> str:
        # leading zeros mean nothing; what is longer than any character's number is beyond the last one
        digits = f"regexp_replace({code}, {raw('^[xX]?0*')}, '')"
        number = f"IF(lower({code}) LIKE 'x%', conv({digits}, 16, 10), {digits})"
        point = f"CASE WHEN {digits} = '' THEN 0 WHEN length({digits}) > 7 THEN 1114112 ELSE CAST({number} AS int) END"
        rest = f"regexp_replace({piece}, {raw(r'^#(?:[0-9]+|[xX][0-9A-Fa-f]+);?')}, '')"
        return f"IF({code} = '', concat('&', {piece}), concat({let(point, character)}, {rest}))"

    return let(f"regexp_extract({piece}, {raw(r'^#([0-9]+|[xX][0-9A-Fa-f]+)')}, 1)", build)


def decode_entities(value: str, attribute: bool = False) -> str:
    """Replace character references in one pass, so ``&amp;lt;`` becomes ``&lt;``."""
    table = f"from_json({text(_TABLE)}, 'map<string,string>')"
    # inside attributes a reference without ';' counts only before other characters
    bare = raw(rf"^({_BARE})" + (r"(?![=A-Za-z0-9;])" if attribute else ""))

    def unclosed(p: str) -> str:
        return let(f"regexp_extract({p}, {bare}, 1)", lambda n: f"""IF({n} = '', concat('&', {p}),
          concat(element_at({table}, {n}), substr({p}, length({n}) + 1)))""")

    def named(p: str) -> str:
        return let(f"regexp_extract({p}, {raw('^([A-Za-z][A-Za-z0-9]*);')}, 1)", lambda n: let(
            f"IF({n} = '', NULL, try_element_at({table}, {n}))",
            lambda c: f"IF({c} IS NULL, {unclosed(p)}, concat({c}, substr({p}, length({n}) + 2)))"))

    def piece(p: str, i: str) -> str:
        return f"CASE WHEN {i} = 0 THEN {p} WHEN startswith({p}, '#') THEN {_numeric(p)} ELSE {named(p)} END"

    return let(value, lambda v: f"""IF(contains({v}, '&'),
      array_join(transform(split({v}, '&'), {lam(piece, 2)}), ''), {v})""")


def _visible(html: str) -> str:
    """Without comments, scripts and styles, found in document order."""
    return f"regexp_replace({html}, {raw(_HIDDEN)}, '')"


def _drop_element(html: str, tag: str) -> str:
    return f"regexp_replace({html}, {raw(rf'(?is)<{tag}{_ENDS}{_IN_TAG}.*?(?:</{tag}{_ENDS}[^>]*>|\z)')}, '')"


def _outside(html: str, tags: tuple[str, ...]) -> str:
    """What lies outside all elements of these names, however they are nested.

    The open elements are kept as a string of one letter each; an end tag closes the last open element of its
    name and all within it, and counts for nothing if there is none. An element without end lasts to the end.
    """
    edge = raw(rf"(?is)</?(?:{'|'.join(tags)}){_ENDS}{_IN_TAG}")
    letters = "".join(t[0] for t in tags)
    assert len(set(letters)) == len(tags)

    def walk(state: str, tag: str) -> str:
        letter = f"lower(regexp_extract({tag}, {raw('^</?(.)')}, 1))"
        last = f"instr(reverse({state}.open), {letter})"
        after = f"""CASE WHEN NOT startswith({tag}, '</') THEN concat({state}.open, {letter})
          WHEN {last} > 0 THEN left({state}.open, length({state}.open) - {last}) ELSE {state}.open END"""
        return let(after, lambda o: struct(open=o, shown=f"concat({state}.shown, IF({o} = '', '1', '0'))"))

    def joined(h: str) -> str:
        flags = f"aggregate(regexp_extract_all({h}, {edge}, 0), {struct(open="''", shown="'1'")}, {lam(walk, 2)}).shown"
        return let(flags, lambda f: f"""array_join(transform(split({h}, {edge}),
          {lam(lambda x, i: f"IF(substr({f}, {i} + 1, 1) = '1', {x}, '')", 2)}), '')""")

    return let(html, lambda h: f"IF({h} RLIKE {edge}, {joined(h)}, {h})")


def _collapse(value: str) -> str:
    return f"trim(regexp_replace({value}, {raw(_SPACE)}, ' '))"


def title(html: str) -> str:
    """First title, references decoded, white space collapsed; '' when there is none."""
    pattern = raw(rf"(?is)<title{_ENDS}{_IN_TAG}(.*?)(?:</title{_ENDS}|\z)")
    return _collapse(decode_entities(f"regexp_extract({_visible(html)}, {pattern}, 1)"))


def main_text(html: str, max_chars: int | None = MAX_CONTENT) -> str:
    """Body text without boilerplate elements. Tags vanish without leaving a space."""
    def body(h: str) -> str:
        start, up_to = raw(rf"(?i)<body{_ENDS}"), raw(rf"(?is)^.*?<body{_ENDS}{_IN_TAG}")
        return f"""IF({h} RLIKE {start}, regexp_replace({h}, {up_to}, ''),
          {_drop_element(_drop_element(h, 'head'), 'title')})"""

    rest = _outside(let(_visible(html), body), BOILERPLATE_TAGS[2:])
    plain = _collapse(decode_entities(f"regexp_replace({rest}, {raw(_TAG)}, '')"))
    return plain if max_chars is None else f"left({plain}, {max_chars})"


def _attributes(open_tag: str, *names: str) -> list[str]:
    """The first value of each attribute in an open tag of a one-letter or longer name, '' without one."""
    found = f"regexp_extract_all(regexp_replace({open_tag}, {raw('^<[^\\s/>]+')}, ''), {raw(_ATTRIBUTE)}, 0)"

    def value(name: str) -> str:
        own = lam(lambda x: f"lower(regexp_extract({x}, {raw('^[^\\s=]+')}, 0)) = '{name}'")
        given = f"regexp_extract(get(filter({found}, {own}), 0), {raw(r'(?s)=\s*(.*)$')}, 1)"
        return decode_entities(f"coalesce(regexp_replace({given}, {raw(r'^[\x22\x27]|[\x22\x27]$')}, ''), '')", attribute=True)

    return [value(n) for n in names]


def base_href(html: str) -> str:
    """The address that a page's relative links start from, as its first <base href> gives it; '' without one."""
    found = f"regexp_extract_all({_visible(html)}, {raw(rf'(?is)<base{_ENDS}{_IN_TAG}')}, 0)"
    given = f"filter(transform({found}, {lam(lambda t: _attributes(t, 'href')[0])}), {lam(lambda h: f'{h} != {text(str())}')})"
    return f"trim(coalesce(get({given}, 0), ''))"


def anchors(html: str, max_text: int | None = MAX_ANCHOR_TEXT) -> str:
    """array<struct<pos,href,text,rel>> of every anchor with a non-empty href, in document order."""
    found = f"regexp_extract_all({_visible(html)}, {raw(_ANCHOR)}, 0)"

    def read(a: str) -> str:
        def fields(tag: str) -> str:
            inner = f"regexp_replace(substr({a}, length({tag}) + 1), {raw(_TAG)}, '')"
            label = f"regexp_replace({decode_entities(inner)}, {raw(_EDGE_SPACE)}, '')"
            href, rel = _attributes(tag, "href", "rel")
            return struct(href=href, text=label if max_text is None else f"left({label}, {max_text})", rel=rel)
        return let(f"regexp_extract({a}, {raw(rf'(?is)^{_OPEN_ANCHOR}')}, 0)", fields)

    kept = f"filter(transform({found}, {lam(read)}), {lam(lambda a: f'''{a}.href != '' ''')})"
    numbered = lam(lambda a, i: struct(pos=f"{i} + 1", href=f"{a}.href", text=f"{a}.text", rel=f"{a}.rel"), 2)
    return f"transform({kept}, {numbered})"
