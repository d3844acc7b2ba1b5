"""URL functions over one split of a URL into its parts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query with its mark, fragment with its mark; shared with the SQL versions.
SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
#: userinfo, host, port with its colon.
AUTHORITY = r"^(?:[^@]*@)?([A-Za-z0-9.-]+|\[[0-9A-Fa-f:.]+\])(:[0-9]*)?$"
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21"}


def split(url: Column) -> dict[str, Column]:
    """The raw parts; scheme is empty where the URL does not parse."""
    u = F.trim(url)
    part = lambda k: F.regexp_extract(u, SPLIT, k)
    authority = part(2)
    return {
        "scheme": part(1),
        "host": F.regexp_extract(authority, AUTHORITY, 1),
        "port": F.regexp_replace(F.regexp_extract(authority, AUTHORITY, 2), ":", ""),
        "path": part(3),
        "query": part(4),
    }


def clean_path(path: Column) -> Column:
    """Dot segments resolved: . goes, .. takes its predecessor along unless there is none, empty segments collapse.

    A trailing . or .. or slash leaves a trailing slash; leading .. stay; an empty path stays empty.
    """
    none = F.array().cast("array<string>")

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        up = (s == "..") & (F.size(done) > 0) & (F.coalesce(last, F.lit("")) != "..")
        return F.when((s == "") | (s == "."), done).when(up, F.slice(done, 1, F.size(done) - 1)).otherwise(F.array_append(done, s))

    kept = F.aggregate(F.split(path, "/"), none, add)
    tail = path.rlike(r"(^|/)\.{0,2}$") & (F.size(kept) > 0) & (F.coalesce(F.element_at(kept, -1), F.lit("")) != "..")
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(tail, "/").otherwise(""))
    return F.when(path == "", "").otherwise(joined)


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, without default port, user info and fragment, dot segments resolved, the query
    as it is; null for what does not parse (null, blank and comment lines, schemes without authority, odd hosts)."""
    p = split(url)
    scheme, host = F.lower(p["scheme"]), F.lower(p["host"])
    default = F.lit(False)
    for s, port in DEFAULT_PORTS.items():
        default = default | ((scheme == s) & (p["port"] == port))
    port = F.when((p["port"] == "") | default, "").otherwise(F.concat(F.lit(":"), p["port"]))
    good = (p["scheme"] != "") & (p["host"] != "")
    return F.when(good, F.concat(scheme, F.lit("://"), host, port, clean_path(p["path"]), p["query"]))


def domain(url: Column) -> Column:
    """The host in lower case without a leading www.; https is assumed where no http scheme is given."""
    u = F.trim(url)
    full = F.when(F.lower(u).rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    host = F.regexp_replace(F.lower(split(full)["host"]), r"^www\.", "")
    return F.when(host != "", host)


def robots_key(url: Column) -> Column:
    """scheme://host[:port] as written."""
    p = split(url)
    port = F.when(p["port"] == "", "").otherwise(F.concat(F.lit(":"), p["port"]))
    return F.when((p["scheme"] != "") & (p["host"] != ""), F.concat(p["scheme"], F.lit("://"), p["host"], port))


def robots_path(url: Column) -> Column:
    """The path that robots rules are matched with, without query."""
    p = split(url)
    return F.when(p["scheme"] != "", p["path"])


def is_http(url: Column) -> Column:
    return F.coalesce(url.startswith("http"), F.lit(False))


def resolve(base: Column, link: Column) -> Column:
    """link against base: absolute links as they are, //host, /path, ?query and relative ones completed; empty for an
    empty link, #fragment kept. Links of schemes without authority (mailto: and the like) stay as they are."""
    p = split(base)
    root = F.concat(p["scheme"], F.lit("://"), F.regexp_extract(F.trim(base), SPLIT, 2))
    folder = F.regexp_replace(F.when(p["path"] == "", "/").otherwise(p["path"]), "[^/]*$", "")
    here = F.concat(root, p["path"])
    raw = F.trim(link)
    path = F.regexp_extract(raw, r"^([^?#]*)", 1)
    rest = F.substring(raw, F.length(path) + 1, 1 << 30)
    return (
        F.when(raw == "", "")
        .when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), raw)
        .when(raw.startswith("//"), F.concat(p["scheme"], F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(root, clean_path(path), rest))
        .when(raw.startswith("?"), F.concat(here, raw))
        .when(raw.startswith("#"), F.concat(here, p["query"], raw))
        .otherwise(F.concat(root, clean_path(F.concat(folder, path)), rest))
    )


def sql_normalize(url: str) -> str:
    """The same normal form as a SQL expression, but for paths with dot segments, which are resolved by a fold."""
    u = f"trim({url})"
    scheme, authority = f"lower(regexp_extract({u}, '{SPLIT}', 1))", f"regexp_extract({u}, '{SPLIT}', 2)"
    host, port = f"lower(regexp_extract({authority}, '{AUTHORITY}', 1))", f"regexp_extract({authority}, '{AUTHORITY}', 2)"
    default = " OR ".join(f"({scheme} = '{s}' AND {port} = ':{n}')" for s, n in DEFAULT_PORTS.items())
    path, query = f"regexp_extract({u}, '{SPLIT}', 3)", f"regexp_extract({u}, '{SPLIT}', 4)"
    return f"""CASE WHEN {scheme} <> '' AND {host} <> '' THEN {scheme} || '://' || {host}
      || CASE WHEN {port} IN ('', ':') OR {default} THEN '' ELSE {port} END || {sql_path(path)} || {query} END"""


def sql_path(path: str) -> str:
    kept = f"""list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split({path}, '/'), lambda s: [s])),
      lambda d, x: CASE WHEN x[1] IN ('', '.') THEN d WHEN x[1] = '..' AND len(d) > 0 AND d[-1] <> '..' THEN d[:-2] ELSE list_concat(d, x) END)"""
    return f"""CASE WHEN {path} = '' THEN '' ELSE '/' || array_to_string({kept}, '/')
      || CASE WHEN regexp_matches({path}, '(^|/)\\.{{0,2}}$') AND len({kept}) > 0 AND ({kept})[-1] <> '..' THEN '/' ELSE '' END END"""


def sql_domain(url: str) -> str:
    full = f"CASE WHEN regexp_matches(lower(trim({url})), '^https?://') THEN trim({url}) ELSE 'https://' || trim({url}) END"
    host = f"regexp_replace(lower(regexp_extract(regexp_extract({full}, '{SPLIT}', 2), '{AUTHORITY}', 1)), '^www\\.', '')"
    return f"nullif({host}, '')"
