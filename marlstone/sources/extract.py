"""Text of files by kind: mail, office documents, clinical XML, PDF and images.

Parsers are standard library only; PDF and image readers are optional and
given by the caller.  Files arrive as binary columns, Arrow batch by batch.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIPPED = ("application/pkcs7-signature", "application/x-pkcs7-signature", "application/pgp-signature", "text/calendar")


def mail(content: bytes, least: int = 512) -> dict:
    """Headers, text body, attachments of ``least`` bytes or more, and all as one text."""
    m = email.message_from_bytes(content, policy=email.policy.default)
    get = lambda h: str(m.get(h, "") or "")
    bodies, files = [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        kind, name = part.get_content_type(), part.get_filename()
        if kind in _SKIPPED:
            continue
        if kind == "text/plain" and not name:
            try:
                bodies.append(part.get_content())
            except (LookupError, UnicodeError):
                bodies.append(part.get_payload(decode=True).decode("utf-8", "replace"))
        elif name:
            payload = part.get_payload(decode=True) or b""
            if len(payload) >= least:
                files.append({"filename": name, "content_type": kind, "size": len(payload)})
    body = "\n".join(bodies).strip()
    head = "\n".join(f"{h}: {get(h)}" for h in ("From", "To", "Cc", "Date", "Subject") if get(h))
    references = get("References").split()
    return {
        "message_id": get("Message-ID"), "sender": get("From"), "recipients": get("To"), "subject": get("Subject"), "date": get("Date"),
        "thread_id": references[0] if references else get("Message-ID"), "body": body, "attachments": files, "full_text": f"{head}\n\n{body}",
    }


_MAIL = "message_id string, sender string, recipients string, subject string, date string, thread_id string, body string, attachments array<struct<filename:string,content_type:string,size:int>>, full_text string"


def parse_mail(files: DataFrame, content: str = "content") -> DataFrame:
    @F.pandas_udf(f"struct<{_MAIL.replace(' array', ':array').replace(' string', ':string')}>")
    def run(blobs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([mail(bytes(b)) for b in blobs])

    return files.withColumn("m", run(F.col(content))).select(*[c for c in files.columns if c != content], "m.*")


def _xml_text(raw: bytes, paragraph: str, run: str) -> list[str]:
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    return ["".join(x.text or "" for x in p.iter() if local(x) == run) for p in ElementTree.fromstring(raw).iter() if local(p) == paragraph]


def docx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return "\n".join(x for x in _xml_text(z.read("word/document.xml"), "p", "t") if x.strip())


def pptx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        return "\n\n".join(f"[Slide {i}]\n" + "\n".join(x for x in _xml_text(z.read(n), "p", "t") if x.strip()) for i, n in slides)


def xlsx(content: bytes) -> str:
    """Each sheet under its name, its non-empty cells joined row by row."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(si) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(s) == "sheet"]
        out = []
        for i, name in enumerate(names, 1):
            lines = []
            for row in (e for e in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter() if local(e) == "row"):
                cells = []
                for c in (e for e in row if local(e) == "c"):
                    v = next((x.text for x in c.iter() if local(x) in ("v", "t") and x.text), None)
                    if v is not None:
                        cells.append(shared[int(v)] if c.get("t") == "s" else v)
                if any(c.strip() for c in cells):
                    lines.append(" | ".join(c for c in cells if c.strip()))
            out.append(f"[Sheet: {name}]\n" + "\n".join(lines))
        return "\n\n".join(out)


def delimited(content: bytes, most: int = 5000) -> str:
    import csv

    text = content.decode("utf-8", "ignore")
    rows = csv.reader(io.StringIO(text), delimiter="\t" if text.count("\t") > text.count(",") else ",")
    return "\n".join(" | ".join(c.strip() for c in r if c.strip()) for _, r in zip(range(most), rows, strict=False) if any(c.strip() for c in r))


def clinical(content: bytes) -> dict:
    """Patient, document date, version and titled sections of a clinical document."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    root = ElementTree.fromstring(content)
    first = lambda name, e=root: next((x for x in e.iter() if local(x) == name), None)
    text = lambda e: re.sub(r"\s+", " ", " ".join(e.itertext())).strip() if e is not None else ""
    patient = first("patient")
    sections = [{"title": text(first("title", s)), "text": text(first("text", s))} for s in root.iter() if local(s) == "section"]
    attr = lambda name, key: (e.get(key) or "") if (e := first(name)) is not None else ""
    return {"patient": text(first("name", patient)) if patient is not None else "", "date": attr("effectiveTime", "value"), "set_id": attr("setId", "root"), "version": attr("versionNumber", "value"), "sections": sections}


def plain(content: bytes, most: int = 500_000) -> str:
    return content.decode("utf-8", "ignore")[:most]


Reader = Callable[[bytes], str]
READERS: dict[str, tuple[str, Reader]] = {
    **{e: ("plain", plain) for e in ("txt", "md", "log", "py", "json", "yaml", "yml", "xml")},
    **{e: ("delimited", delimited) for e in ("csv", "tsv")},
    "docx": ("docx", docx), "pptx": ("pptx", pptx), "xlsx": ("xlsx", xlsx), "eml": ("mail", lambda b: mail(b)["full_text"]),
}


def extract_text(files: DataFrame, path: str = "path", content: str = "content", extra: dict[str, tuple[str, Reader]] | None = None) -> DataFrame:
    """``files`` with ``text`` and ``method`` by extension; unknown kinds are ("", "unsupported"), broken files ("", "failed").

    ``extra`` adds or replaces readers, as for PDF and images.
    """
    readers = {**READERS, **(extra or {})}

    @F.pandas_udf("struct<text:string,method:string>")
    def run(paths: pd.Series, blobs: pd.Series) -> pd.DataFrame:
        out = []
        for p, b in zip(paths, blobs, strict=True):
            method, read = readers.get(p.rsplit(".", 1)[-1].lower() if "." in p else "", ("unsupported", None))
            try:
                out.append((read(bytes(b)) if read and b is not None else "", method))
            except Exception:  # a broken file must not end the batch
                out.append(("", "failed"))
        return pd.DataFrame(out, columns=["text", "method"])

    return files.withColumn("__x", run(F.col(path), F.col(content))).select(*[c for c in files.columns if c != content], "__x.text", "__x.method")
