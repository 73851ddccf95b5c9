"""Provider responses as typed records: Crossref, DataCite and CSL JSON, Atom feeds, TEI."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_NAME = "struct<given:string,family:string,name:string,literal:string>"
_CROSSREF = f"struct<message:struct<DOI:string,title:array<string>,author:array<{_NAME}>,issued:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>>>"
_DATACITE = "struct<data:struct<attributes:struct<doi:string,titles:array<struct<title:string>>,creators:array<struct<name:string,givenName:string,familyName:string>>,publicationYear:int,publisher:string>>>"
_CSL = f"struct<DOI:string,title:string,author:array<{_NAME}>,issued:struct<`date-parts`:array<array<int>>>,`container-title`:string>"


def _full(names):
    part = F.transform(names, lambda n: F.coalesce(n["name"], n["literal"], F.nullif(F.concat_ws(" ", n["given"], n["family"]), F.lit(""))))
    return F.filter(part, lambda n: n.isNotNull() & (F.trim(n) != ""))


def _year(issued):
    return F.get(F.get(issued["date-parts"], F.lit(0)), F.lit(0))


def crossref(responses: DataFrame) -> DataFrame:
    """(request_id, doi, title, authors, year, venue) of (request_id, body); bodies that are no JSON give null fields."""
    m = responses.select("request_id", F.from_json("body", _CROSSREF)["message"].alias("m"))
    return m.select("request_id", F.lower("m.DOI").alias("doi"), F.get("m.title", F.lit(0)).alias("title"), _full(F.col("m.author")).alias("authors"), _year(F.col("m.issued")).alias("year"), F.get("m.container-title", F.lit(0)).alias("venue"))


def datacite(responses: DataFrame) -> DataFrame:
    """The same fields of DataCite responses."""
    a = responses.select("request_id", F.from_json("body", _DATACITE)["data"]["attributes"].alias("a"))
    people = F.transform("a.creators", lambda c: F.coalesce(F.nullif(F.concat_ws(" ", c["givenName"], c["familyName"]), F.lit("")), c["name"]))
    return a.select("request_id", F.lower("a.doi").alias("doi"), F.get("a.titles", F.lit(0))["title"].alias("title"), people.alias("authors"), F.col("a.publicationYear").alias("year"), F.col("a.publisher").alias("venue"))


def csl(responses: DataFrame) -> DataFrame:
    """The same fields of CSL JSON items."""
    c = responses.select("request_id", F.from_json("body", _CSL).alias("c"))
    return c.select("request_id", F.lower("c.DOI").alias("doi"), "c.title", _full(F.col("c.author")).alias("authors"), _year(F.col("c.issued")).alias("year"), F.col("c.container-title").alias("venue"))


def atom(responses: DataFrame) -> DataFrame:
    """(request_id, arxiv_id, title, authors, year) of every entry of Atom feeds."""
    entry = F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<entry>(.*?)</entry>"), 1)).alias("e")
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    e = responses.select("request_id", entry)
    return e.select(
        "request_id", F.regexp_extract("e", r"<id>[^<]*?/abs/([^<]+?)(?:v[0-9]+)?</id>", 1).alias("arxiv_id"), clean(F.regexp_extract("e", r"(?s)<title>(.*?)</title>", 1)).alias("title"),
        F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<name>(.*?)</name>"), 1), clean).alias("authors"), F.regexp_extract("e", r"<published>([0-9]{4})", 1).try_cast("int").alias("year"),
    )


def tei(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, text, confidence): title, heads and bibliography of TEI documents as candidates."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))
    parts = []
    for kind, pattern, confidence in (("title", r"(?s)<titleStmt>.*?<title[^>]*>(.*?)</title>", 0.98), ("heading", r"(?s)<head[^>]*>(.*?)</head>", 0.95), ("reference", r"(?s)<biblStruct[^>]*>(.*?)</biblStruct>", 0.94)):
        found = F.explode(F.regexp_extract_all("body", F.lit(pattern), 1)).alias("raw")
        parts.append(documents.select("doc_id", found).select("doc_id", F.lit(kind).alias("kind"), clean(F.col("raw")).alias("text"), F.lit(confidence).alias("confidence")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("text != ''")
