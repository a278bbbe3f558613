"""Deterministic identifiers and canonical forms as Column expressions."""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Namespace of stable ids. Fixed value: ids must agree with those already published.
NAMESPACE = uuid.UUID("7087e635-619a-5b41-99bc-c8ab98842348")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC form; ASCII text is its own and stays in the JVM."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_nfkc(text))


def collapse(text: Column) -> Column:
    """Trimmed, with every run of white space as one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """NFKC, trimmed, white space collapsed."""
    return collapse(nfkc(text))


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """Name-based UUID, version 5, from built-in functions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1), 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def stable_id(kind: str, *parts: Column, ascii_only: bool = False) -> Column:
    """`obs:<kind>:<uuid5 of the kind and the parts, lower-case, joined by |>`; an empty part is an error."""
    clean = [F.lower(collapse(p) if ascii_only else normalize_text(p)) for p in parts]
    empty = F.lit(False)
    for c in clean:
        empty = empty | c.isNull() | (c == "")
    made = F.concat(F.lit(f"obs:{kind}:"), uuid5(F.concat_ws("|", F.lit(kind), *clean)))
    return F.when(empty, F.raise_error(F.lit(f"{kind} id needs all its parts")).cast("string")).otherwise(made)


def content_hash(data: Column) -> Column:
    """SHA-256 as lower-case hex."""
    return F.sha2(data, 256)


def digits_hash(value: Column) -> Column:
    """SHA-256 of the digits alone; null without digits."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(digits != "", F.sha2(digits, 256))


def _percent_decoded(text: Column) -> Column:
    """Percent-escapes resolved, a plus sign as it is; text without valid escapes stays."""
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)).otherwise(text)


def canonical_doi(value: Column, ascii_only: bool = False) -> Column:
    """Lower-case DOI without resolver, prefix, closing punctuation or percent-escapes; null if it is none. ascii_only leaves out NFKC, for use within array functions."""
    given = F.coalesce(value, F.lit(""))
    text = F.lower(_percent_decoded(collapse(given) if ascii_only else normalize_text(given)))
    # A resolver's address: its path alone counts.
    path = F.regexp_extract(text, r"^[a-z][a-z0-9+.-]*://(?:(?:dx|www)\.)?doi\.org/+([^?#]*)", 1)
    # Parameters of the path's last part are not of the DOI.
    text = F.when(path != "", F.regexp_replace(path, ";[^/]*$", "")).otherwise(text)
    text = F.regexp_replace(text, r"^(?:doi\s*:\s*|https?://(?:dx\.)?doi\.org/)", "")
    text = F.regexp_replace(text, r"[ .;,)]+$", "")
    return F.when(text.rlike(r"^10\.\d{4,9}/\S+$"), text)


def extract_doi(text: Column) -> Column:
    """The first DOI in a text, canonical."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"), F.lit(0))
    return F.get(F.filter(F.transform(found, lambda x: F.regexp_replace(F.lower(x), r"[ .;,)]+$", "")), lambda d: d.rlike(r"^10\.\d{4,9}/\S+$")), F.lit(0))


def canonical_identifier(scheme: Column, value: Column) -> Column:
    """Canonical form of an identifier of a known scheme, null where it is not one; of other schemes the text with single spaces."""
    v, s = F.trim(F.coalesce(value, F.lit(""))), F.lower(scheme)
    arxiv = F.regexp_replace(F.regexp_replace(v, r"(?i)^(?:arxiv:|https?://arxiv\.org/(?:abs|pdf)/)", ""), r"v\d+(?:\.pdf)?$", "")
    orcid = F.upper(F.regexp_replace(v, r"(?i)^https?://orcid\.org/", ""))
    ror = F.lower(F.regexp_replace(v, r"(?i)^https?://ror\.org/", ""))
    pmid = F.regexp_replace(F.upper(v), "^PMID", "")
    bare = F.regexp_replace(F.upper(v), "^PMCID", "")
    pmcid = F.when(bare.startswith("PMC"), bare).otherwise(F.concat(F.lit("PMC"), bare))
    openalex = F.upper(F.substring_index(v, "/", -1))
    return (
        F.when(v == "", None)
        .when(s == "doi", canonical_doi(v))
        # The letters of ".pdf" are taken off the end one by one.
        .when(s == "arxiv", F.regexp_replace(arxiv, r"[.pdf]+$", ""))
        .when(s == "orcid", F.when(orcid.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$"), orcid))
        .when(s == "ror", F.when(ror.rlike(r"^0[0-9a-hj-km-np-tv-z]{8}$"), ror))
        .when(s == "pmid", F.when(F.regexp_replace(pmid, "^PMC", "").rlike(r"^\d+$"), pmid))
        .when(s == "pmcid", F.when(F.regexp_replace(pmcid, "^PMC", "").rlike(r"^\d+$"), pmcid))
        .when(s == "openalex", F.when(openalex.rlike(r"^[WASITKPF]\d+$"), openalex))
        .otherwise(collapse(v))
    )
