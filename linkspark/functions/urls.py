"""URL rules as SQL expressions: every function takes and gives expression text."""

from __future__ import annotations

from linkspark.functions.sql import lam, let, raw, struct

MAX_URL_LENGTH = 2048

# Fixed value: the strict URL pattern. Domain with a 2-6 letter top level, localhost or IPv4.
STRICT_URL = (
    r"(?i)^https?://"
    r"(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|"
    r"localhost|"
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"
    r"(?::\d+)?"
    r"(?:/?|[/?]\S+)$"
)

# scheme, netloc, path, ;params of the last segment, ?query, #fragment
PARTS = ("scheme", "netloc", "path", "params", "query", "fragment")
_PARTS = (r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?"
          r"((?:[^?#]*/)?[^?#;/]*)(?:;([^?#/]*))?(?:\?([^#]*))?(?:#(.*))?$")
_DOTS = r"(^|/)\.\.?(/|$)"


def strip(c: str) -> str:
    """Drop white space (in the Unicode sense) at both ends."""
    return f"regexp_replace({c}, {raw(r'(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$')}, '')"


def split_url(url: str) -> str:
    """struct(scheme, netloc, path, params, query, fragment); absent parts are ''.

    Generic-syntax splitting that takes any string: control characters in front are dropped,
    tabs and line ends removed, the scheme lower-cased, ``;params`` cut off the last segment.
    """
    clean = rf"translate(regexp_replace({url}, {raw(r'^[\x00-\x20]+')}, ''), '\t\r\n', '')"

    def parts(u: str) -> str:
        found = {name: f"regexp_extract({u}, {raw(_PARTS)}, {i})" for i, name in enumerate(PARTS, 1)}
        return struct(**{**found, "scheme": f"lower({found['scheme']})"})

    return let(clean, parts)


def join_url(u: str) -> str:
    """Inverse of :func:`split_url` on a bound struct; empty parts leave no separator behind."""
    empty = f"({u}.path = '' AND {u}.params = '')"
    rooted = f"startswith({u}.path, '/')"
    web = f"{u}.scheme IN ('http', 'https', 'ftp')"

    def part(mark: str, name: str) -> str:
        return f"IF({u}.{name} = '', '', concat('{mark}', {u}.{name}))"

    return f"""concat(IF({u}.scheme = '', '', concat({u}.scheme, ':')),
      CASE WHEN {u}.netloc != '' THEN concat('//', {u}.netloc, IF({empty} OR {rooted}, '', '/'))
           WHEN startswith({u}.path, '//') OR ({web} AND ({empty} OR {rooted})) THEN '//' ELSE '' END,
      {u}.path, {part(';', 'params')}, {part('?', 'query')}, {part('#', 'fragment')})"""


def _unbalanced(netloc: str) -> str:
    return f"contains({netloc}, '[') != contains({netloc}, ']')"


def canonical(url: str) -> str:
    """struct(canonical, netloc, reason): one form per resource, or NULL and why not."""

    def build(u: str) -> str:
        host = f"lower({u}.netloc)"
        return struct(
            scheme=f"{u}.scheme",
            netloc=f"""CASE WHEN {u}.scheme = 'http' AND endswith({u}.netloc, ':80') THEN left({host}, length({host}) - 3)
              WHEN {u}.scheme = 'https' AND endswith({u}.netloc, ':443') THEN left({host}, length({host}) - 4)
              ELSE {host} END""",
            path=f"""CASE WHEN {u}.path IN ('', '/') THEN '/'
              WHEN endswith({u}.path, '/') THEN left({u}.path, length({u}.path) - 1) ELSE {u}.path END""",
            params=f"{u}.params",
            query=f"IF({u}.query = '', '', array_join(array_sort(split({u}.query, '&')), '&'))",
            fragment="''",
            reason=f"""CASE WHEN {u}.scheme IS NULL THEN 'null'
              WHEN {u}.scheme NOT IN ('http', 'https') THEN 'scheme'
              WHEN {_unbalanced(f'{u}.netloc')} THEN 'netloc' END""")

    def result(u: str) -> str:
        return struct(canonical=f"IF({u}.reason IS NULL, {join_url(u)}, NULL)",
                      netloc=f"IF({u}.reason IS NULL, {u}.netloc, NULL)", reason=f"{u}.reason")

    return let(let(split_url(strip(url)), build), result)


def invalid_reason(url: str) -> str:
    """NULL for a valid URL, else the first rule it breaks: null, scheme, netloc, length."""
    return let(split_url(url), lambda u: f"""CASE WHEN {url} IS NULL THEN 'null'
      WHEN {u}.scheme NOT IN ('http', 'https') THEN 'scheme'
      WHEN {u}.netloc = '' OR {_unbalanced(f'{u}.netloc')} THEN 'netloc'
      WHEN length({url}) > {MAX_URL_LENGTH} THEN 'length' END""")


def url_hash(canonical_url: str) -> str:
    return f"sha2({canonical_url}, 256)"


def canonical_hash(url: str) -> str:
    return url_hash(f"{canonical(url)}.canonical")


def host(url: str) -> str:
    return f"lower({split_url(url)}.netloc)"


def _without_dots(path: str) -> str:
    """Resolve '.' and '..' segments; paths without any pass through untouched."""
    def step(acc: str, x: str) -> str:
        return (f"CASE WHEN {x} = '..' THEN slice({acc}, 1, greatest(size({acc}) - 1, 0)) "
                f"WHEN {x} = '.' THEN {acc} ELSE concat({acc}, array({x})) END")

    def walk(parts: str) -> str:
        done = f"aggregate({parts}, CAST(array() AS array<string>), {lam(step, 2)})"
        return let(done, lambda d: f"""concat(array_join({d}, '/'),
          IF(element_at({parts}, -1) IN ('.', '..') AND size({d}) > 0, '/', ''))""")

    return f"IF({path} RLIKE {raw(_DOTS)}, {let(f'''split({path}, '/')''', walk)}, {path})"


def base_parts(base: str) -> str:
    """:func:`split_url` of a page URL plus ``dir``, the folder its relative links start from."""
    folder = raw(r"(?s)^(.*/)")
    return let(split_url(base), lambda b: struct(
        url=base, **{p: f"{b}.{p}" for p in PARTS[:-1]},
        dir=f"IF({b}.path = '', '/', regexp_extract({b}.path, {folder}, 1))"))


def resolve(base: str, href: str) -> str:
    """Absolute form of ``href`` on the page described by ``base`` (see :func:`base_parts`)."""

    def build(h: str) -> str:
        scheme = f"IF({h}.scheme = '', {base}.scheme, {h}.scheme)"
        own_host = f"{h}.netloc != ''"
        same_page = f"({h}.netloc = '' AND {h}.path = '' AND {h}.params = '')"
        merged = let(f"""IF(startswith({h}.path, '/'), {h}.path,
          regexp_replace(concat({base}.dir, {h}.path), '/{{2,}}', '/'))""", _without_dots)
        joined = struct(
            scheme=scheme,
            netloc=f"IF({own_host}, {h}.netloc, {base}.netloc)",
            path=f"""CASE WHEN {own_host} THEN {h}.path WHEN {same_page} THEN {base}.path
              ELSE {let(merged, lambda m: f"IF({m} = '', '/', {m})")} END""",
            params=f"IF({same_page}, {base}.params, {h}.params)",
            query=f"IF({same_page} AND {h}.query = '', {base}.query, {h}.query)",
            fragment=f"{h}.fragment")
        return f"""CASE WHEN {href} = '' THEN {base}.url
          WHEN {scheme} != {base}.scheme OR {scheme} NOT IN ('', 'http', 'https', 'ftp') THEN {href}
          ELSE {let(joined, join_url)} END"""

    return let(split_url(href), build)


def unquote(c: str) -> str:
    """Percent-decoding that leaves '+' and malformed escapes as they are."""
    stray = raw(r"%(?![0-9A-Fa-f]{2})")
    return f"IF(contains({c}, '%'), try_url_decode(replace(regexp_replace({c}, {stray}, '%25'), '+', '%2B')), {c})"


def quote(c: str) -> str:
    """Percent-encode everything but unreserved characters and '/'."""
    out = f"url_encode({c})"
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = f"replace({out}, '{found}', '{wanted}')"
    return out
