"""Scans of XML corpora: one document per input row, one output row per line, word or entry."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import udtf

from ..runtime import lateral

#: Tags of the Sanskrit dictionary whose own text isn't English.
NOT_ENGLISH = frozenset({"s", "s1", "ls", "ab", "lex", "hom", "info", "lang", "gk", "etym", "ns", "bio", "bot", "root", "pb", "srs", "shc", "vlex", "abE", "pcol"})


def local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def plain_entities(xml: Column) -> Column:
    """Undefined entities as _name_, default namespaces off, so that any parser takes the text."""
    x = F.regexp_replace(xml, "&(?!(?:amp|lt|gt|quot|apos|#\\d+|#x[0-9A-Fa-f]+);)([A-Za-z0-9.]+);", "_$1_")
    return F.regexp_replace(x, "\\sxmlns=\"[^\"]*\"", "")


def root_of(xml: str | None):
    try:
        return ET.fromstring(xml) if xml else None
    except ET.ParseError:
        return None


@udtf(returnType="ord int, line_id string, corresp string, text string")
class TeiLines:
    """Lines of a TEI text: the forms of its words, or its plain text without any; empty ones are dropped."""

    def eval(self, xml: str):
        root = root_of(xml)
        n = 0
        for line in root.iter() if root is not None else ():
            if local(line.tag) != "l" or not line.get("id"):
                continue
            ws = [w for w in line.iter() if local(w.tag) == "w"]
            forms = [f for w in ws if (f := (w.get("form") or "").strip()) not in ("", "X", "&X;", "_X_")]
            text = " ".join(forms) if ws else " ".join("".join(line.itertext()).split())
            if text:
                yield n, line.get("id"), line.get("corresp"), text
                n += 1


@udtf(returnType="ord int, key string, text string")
class TeiTranslations:
    """Each paragraph with id, corresp and text, under both of its keys."""

    def eval(self, xml: str):
        root = root_of(xml)
        n = 0
        for p in root.iter() if root is not None else ():
            text = " ".join("".join(p.itertext()).split()) if local(p.tag) == "p" else ""
            if text and p.get("id") and p.get("corresp"):
                yield n, p.get("corresp"), text
                yield n + 1, p.get("id"), text
                n += 2


@udtf(returnType="doc_id string, line_no int, ord int, trans string, lemma string, gloss string, features string, category string, extra string, sumerograms array<string>, akkadograms array<string>, determinatives array<string>")
class TabletWords:
    """Words of a tablet in order with their line (counted by line breaks that follow text) and chosen analysis."""

    def eval(self, xml: str):
        root = root_of(xml)
        if root is None:
            return
        doc_id = next((e.text.strip() for e in root.iter() if local(e.tag) == "docID" and e.text), None)
        line, filled, n = 0, False, 0
        for e in root.iter():
            if local(e.tag) == "lb":
                line, filled = line + filled, False
            elif local(e.tag) == "w":
                trans = e.get("trans", "")
                signs: dict[str, list[str]] = {"sGr": [], "aGr": [], "d": []}
                for c in e.iter():
                    if c is not e and local(c.tag) in signs and (c.text or "").strip():
                        signs[local(c.tag)].append(c.text.strip())
                yield doc_id, line, n, trans, *(chosen_analysis(e.attrib) or (None,) * 5), signs["sGr"], signs["aGr"], signs["d"]
                filled, n = filled or bool(trans), n + 1


def chosen_analysis(attrs) -> tuple[str, ...] | None:
    """lemma, gloss, features, category, extra of the analysis that mrp0sel names: none for DEL, the first without a number; a named one that is absent is none."""
    sel = (attrs.get("mrp0sel") or "").strip()
    if sel == "DEL":
        return None
    number = re.search(r"\d+", sel)
    text = attrs.get(f"mrp{number[0] if number else 1}")
    if not text or not text.strip():
        return None
    parts = [p.strip() for p in text.split("@")]
    return tuple((parts + [""] * 5)[:5])


@udtf(returnType="ord int, key string, glosses array<string>")
class LexiconEntries:
    """Headword and translations of each entryFree; entries without a translation are dropped."""

    def eval(self, xml: str):
        root = root_of(xml)
        n = 0
        for e in root.iter() if root is not None else ():
            if local(e.tag) == "entryFree" and e.get("key"):
                glosses = [g for t in e.iter() if local(t.tag) == "tr" and (g := re.sub(r"[\s,.;:—\-]+$", "", "".join(t.itertext()).strip()))]
                if glosses:
                    yield n, e.get("key"), glosses
                    n += 1


def english_text(e) -> str:
    """An element's text without that of elements in other languages; what follows those is kept."""
    out = [e.text or ""]
    for c in e:
        out += ["" if local(c.tag) in NOT_ENGLISH else english_text(c), c.tail or ""]
    return "".join(out)


@udtf(returnType="ord int, key string, body string")
class DictionaryEntries:
    """Headword and English text of the body of each entry H1 to H4, with or without a letter A to E."""

    def eval(self, xml: str):
        root = root_of(xml)
        n = 0
        for e in root.iter() if root is not None else ():
            if re.fullmatch("H[1-4][A-E]?", local(e.tag)):
                key, body = e.find(".//key1"), e.find(".//body")
                if key is not None and (key.text or "").strip() and body is not None:
                    yield n, key.text.strip(), english_text(body)
                    n += 1


def scan(docs: DataFrame, table_function, xml: str, keep: list[str]) -> DataFrame:
    """The rows that a table function makes of each document, with the kept columns."""
    return lateral(docs.select(*keep, plain_entities(F.col(xml)).alias("_xml")), table_function, "_xml")


def lemma_records(words: DataFrame) -> DataFrame:
    """form, cf, gw, pos (60 characters at most) of analysed words."""
    good = (F.coalesce("lemma", F.lit("")) != "")
    return words.where(good).select("doc_id", F.col("trans").alias("form"), F.col("lemma").alias("cf"), F.col("gloss").alias("gw"), F.substring("features", 1, 60).alias("pos"), "category", (F.size("sumerograms") > 0).alias("has_sumerogram"), (F.size("akkadograms") > 0).alias("has_akkadogram"))


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, ord, href) of anchors in html, in order."""
    found = F.regexp_extract_all("html", F.lit("<a[^>]*\\shref=\"([^\"]*)\""), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("ord", "href"))


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags off, blanks collapsed."""
    x = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "\\s+", " "))
