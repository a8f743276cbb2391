"""URL normal form and its parts, as column expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Cols = Column | str


def _col(c: Cols) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_parts(url: Cols) -> Column:
    """struct<scheme, host, port, path> of an http or https URL; null where it isn't one.

    The query is cut; a fragment is cut from the path, not from the address. The host is in lower case only where a
    port is given, which is how the index' keys have always been written, so the form isn't a fixed point for hosts
    in capitals.
    """
    raw = _col(url)
    scheme, host, port, path = _parts(raw)
    return F.when(_good(raw, port), F.struct(scheme.alias("scheme"), host.alias("host"), port.alias("port"), path.alias("path")))


def _parts(raw: Column) -> tuple[Column, Column, Column, Column]:
    """scheme, host, port, path, each straight from the text: parts made of parts would make plans that grow without end."""
    scheme = F.regexp_extract(raw, "^(https?)://", 1)
    named = F.regexp_extract(raw, "^https?://([^/?:]*)", 1)
    has_port = raw.rlike("^https?://[^/?:]*:")
    # Java's integers: an optional sign and digits.
    number = F.regexp_extract(raw, "^https?://[^/?:]*:([+-]?[0-9]+)(?:[/?]|$)", 1).try_cast("int")
    port = F.when(has_port, number).when(F.startswith(raw, F.lit("https:")), F.lit(443)).otherwise(F.lit(80))
    path = F.regexp_extract(raw, "^https?://[^/?]*(/[^?#]*)", 1)
    return scheme, F.when(has_port, F.lower(named)).otherwise(named), port, F.when(path == "", F.lit("/")).otherwise(path)


def _good(raw: Column, port: Column) -> Column:
    return raw.rlike(r"^https?://[^/?]*[^\s/?]") & port.isNotNull()


def normalize_url(url: Cols) -> Column:
    """scheme://host:port/path, the join key of hits, links and ranks; null where the URL can't be parsed."""
    raw = _col(url)
    scheme, host, port, path = _parts(raw)
    return F.when(_good(raw, port), F.concat(scheme, F.lit("://"), host, F.lit(":"), port.cast("string"), path))


def url_host(url: Cols) -> Column:
    return url_parts(url)["host"]


def with_part(url: Cols, **changes: Column) -> Column:
    """The normal form with other parts (scheme, host, port, path)."""
    p = url_parts(url)
    get = {k: changes.get(k, p[k]) for k in ("scheme", "host", "port", "path")}
    return F.when(p.isNotNull(), F.concat(get["scheme"], F.lit("://"), get["host"], F.lit(":"), get["port"].cast("string"), get["path"]))


def host_shard(host: Cols, shards: int = 100) -> Column:
    """The crawl queue of a host."""
    return F.pmod(F.xxhash64(_col(host)), F.lit(shards)).cast("int")


def resolve_rooted(base: Cols, href: Cols) -> Column:
    """Absolute URL of an href that is absolute, of another scheme's, protocol-relative or relative to the root.

    Null where the href is relative to the page's folder: ``resolve_any`` knows those.
    """
    base, href = _col(base), F.trim(_col(href))
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")) & (origin != ""), F.concat(origin, href))
    )


@F.pandas_udf(StringType())
def _join(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b, h):
        try:
            return urljoin(b, h.strip()) if b is not None and h is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


def resolve_any(base: Cols, href: Cols) -> Column:
    """Absolute URL of any href: built in where the form allows it, else by Arrow batches."""
    native = resolve_rooted(base, href)
    return F.coalesce(native, _join(F.when(native.isNull(), _col(base)), F.when(native.isNull(), _col(href))))
