"""Addresses, client keys and cache digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repository(url: Column, host: str = "github.com") -> Column:
    """owner and name of a repository URL, null if it isn't one.

    http(s), exactly this host, two path parts of ``[A-Za-z0-9._-]``, not only
    dots, not starting with a dash, a final ``.git`` removed.
    """
    inner = F.regexp_extract(url, r"^https?://" + host.replace(".", r"\.") + r"/([^?#]*)", 1)
    parts = F.filter(F.split(inner, "/"), lambda x: x != "")
    owner, name = F.try_element_at(parts, F.lit(1)), F.regexp_replace(F.try_element_at(parts, F.lit(2)), r"\.git$", "")
    good = lambda c: c.rlike(r"^[A-Za-z0-9._-]+$") & ~c.rlike(r"^\.+$") & ~c.startswith("-") & ~c.contains("..")
    return F.when(good(owner) & good(name), F.struct(owner.alias("owner"), name.alias("name")))


def client_key(forwarded: Column, host: Column) -> Column:
    """Leftmost forwarded address, else the direct one, else ``unknown``."""
    first = F.trim(F.split(forwarded, ",").getItem(0))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(host, F.lit("")), F.lit("unknown"))


def identifier(spelled: Column, host: str = "github.com") -> Column:
    """owner and name of an identifier as users write it: with or without scheme and host, with or without ``.git``."""
    bare = F.regexp_replace(F.trim(spelled), r"^(https?://)?(" + host.replace(".", r"\.") + r"/)?", "")
    return repository(F.concat(F.lit(f"https://{host}/"), bare), host)


def workdir(owner: Column, name: Column) -> Column:
    """Folder of a working copy. It isn't read back: a name may hold the separator itself, so owner and name stay columns."""
    return F.concat_ws("__", owner, name)


KEY_PARTS = ["repo", "commit_sha", "provider_identity", "chunk_version", "index_scope"]


def scope_label(top: Column) -> Column:
    """``topN`` for a sampled index, else empty."""
    return F.when(top > 0, F.concat(F.lit("top"), top.cast("string"))).otherwise("")


def cache_digest(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by NUL; an empty last part (the scope) is left out."""
    head, scope = [p.cast("string") for p in parts[:-1]], parts[-1].cast("string")
    joined = F.concat_ws("\x00", *head)
    return F.substring(F.sha2(F.when(scope == "", joined).otherwise(F.concat(joined, F.lit("\x00"), scope)).cast("binary"), 256), 1, 16)


def key_diff(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Names of the differing parts of two keys, in key order."""
    return F.filter(F.array(*[F.when(~a[k].eqNullSafe(b[k]), F.lit(k)) for k in a]), lambda x: x.isNotNull())


def clone_failure(output: Column) -> Column:
    """Reason and whether to try again, permanent causes first; unknown output is final."""
    low = F.lower(output)
    permanent = F.when(low.rlike("permission|denied|authentication"), "no_access").otherwise("not_found")
    lasting = low.rlike("repository not found|not found|does not exist|authentication failed|permission denied|access denied|invalid username or password")
    passing = low.rlike("gnutls recv error|tls connection|ssl_read|unable to access|could not resolve host|connection reset|connection timed out|operation timed out|empty reply from server|remote end hung up|rpc failed|early eof")
    return F.struct(F.when(lasting, permanent).when(passing, F.lit("network_error")).otherwise("not_found").alias("reason"), (~lasting & passing).alias("retry"))


def admission(truncated: Column, parseable: Column, size_kb: Column, most_files: int = 8000, most_kb: int = 1_572_864) -> Column:
    """First reason against a repository, null if none: truncated listing, too many files, too large."""
    return F.when(truncated, "tree_truncated").when(parseable > most_files, "too_many_files").when(size_kb > most_kb, "too_large")


def http_reason(status: Column) -> Column:
    """Rejection reason of a metadata response; null for success."""
    return F.when(status == 200, F.lit(None)).when(status == 404, "not_found").when(status.isin(401, 403), "no_access").when(status == 429, "rate_limited").otherwise("network_error")
