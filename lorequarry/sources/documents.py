"""Document files: dispatch by kind and size, and word-processor files to tagged lines."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..operators.pages import red

# --- fixed values: the parts that are read, their limits, and the format's names ------
MAIN_PART, STYLE_PART, THEME_PART = "word/document.xml", "word/styles.xml", r"(?i)^word/theme/theme\d+\.xml$"
MAX_PART_BYTES, MAX_PARTS_BYTES = 20 * 1024 * 1024, 28 * 1024 * 1024
WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
RED_NAMES = ("RED", "DARKRED")
# --------------------------------------------------------------------------------------
_W = f"{{{WORD_NS}}}"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder with ``kind`` (pdf, docx or null) and ``problem`` (null if it can be read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.regexp_extract(F.lower(name), r"\.(pdf|docx)$", 1)
    problem = F.when(F.col("length") > X.MAX_DOCUMENT_BYTES, "too large").when(F.lower(name).endswith(".doc"), "old word format").when(kind == "", "unknown kind")
    return files.select("path", name.alias("name"), "length", "content", F.nullif(kind, F.lit("")).alias("kind"), problem.alias("problem"))


def _attr(element, name: str) -> str:
    return "" if element is None else element.get(_W + name) or element.get(name) or ""


def _red_value(value: str) -> bool:
    v = value.replace("#", "").upper()
    if v in RED_NAMES:
        return True
    return bool(re.fullmatch("[0-9A-F]{6}", v)) and red([int(v[k : k + 2], 16) for k in (0, 2, 4)])


class Styles:
    """Whether text is red, by its own properties, its styles and their ancestors, or the defaults."""

    def __init__(self, theme: ElementTree.Element | None, styles: ElementTree.Element | None):
        self.theme: dict[str, str] = {}
        scheme = None if theme is None else next((e for e in theme.iter() if e.tag.endswith("}clrScheme")), None)
        for slot in () if scheme is None else scheme:
            first = next(iter(slot), None)
            value = "" if first is None else first.get("val") or first.get("lastClr") or ""
            if value:
                self.theme[slot.tag.rpartition("}")[2]] = value
        self.styles: dict[str, tuple] = {}
        self.default = None
        if styles is not None:
            for s in styles.iter(f"{_W}style"):
                self.styles[_attr(s, "styleId")] = (self.own(s.find(f".//{_W}rPr")), _attr(s.find(f".//{_W}basedOn"), "val"))
            self.default = self.own(styles.find(f".//{_W}docDefaults//{_W}rPrDefault//{_W}rPr"))

    def own(self, properties) -> bool | None:
        """True or False where a colour, highlight or shading is given, else None."""
        if properties is None:
            return None
        given = []
        for tag, direct, themed in (("color", "val", "themeColor"), ("highlight", "val", None), ("shd", "fill", "themeFill")):
            e = properties.find(f".//{_W}{tag}")
            if e is not None:
                given.append(_attr(e, direct) or (self.theme.get(_attr(e, themed), "") if themed else ""))
        return any(map(_red_value, given)) if given else None

    def inherited(self, style: str) -> bool | None:
        seen = set()
        while style in self.styles and style not in seen:
            seen.add(style)
            own, style = self.styles[style]
            if own is not None:
                return own
        return None


def _runs(paragraph):
    """Runs of a paragraph, not those of paragraphs nested in it."""
    stack = list(reversed(list(paragraph)))
    while stack:
        e = stack.pop()
        if e.tag == f"{_W}p":
            continue
        if e.tag == f"{_W}r":
            yield e
        stack.extend(reversed(list(e)))


def _said(run) -> str:
    shown = {"t": lambda e: "".join(e.itertext()), "instrText": lambda e: "".join(e.itertext()), "tab": lambda e: "\t", "br": lambda e: "\n", "cr": lambda e: "\n"}
    return "".join(shown[name](e) for e in run if (name := e.tag.rpartition("}")[2]) in shown)


def _tidy(s: str) -> str:
    return re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t]+", " ", s.replace(" ", " "))).strip()


def docx_lines(content: bytes) -> list[tuple[str, str | None, str]]:
    """(text, red text, location) of the lines of a file; ValueError if it can't be read."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError("not a word-processor file") from e
    wanted = [i for i in archive.infolist() if i.filename in (MAIN_PART, STYLE_PART) or re.search(THEME_PART, i.filename)]
    if any(i.file_size > MAX_PART_BYTES for i in wanted) or sum(i.file_size for i in wanted) > MAX_PARTS_BYTES:
        raise ValueError("text parts too large")
    parts = {i.filename: archive.read(i) for i in wanted}
    if MAIN_PART not in parts:
        raise ValueError("not a word-processor file")
    tree = lambda name: ElementTree.fromstring(parts[name]) if name in parts else None
    styles = Styles(tree(next((n for n in parts if re.search(THEME_PART, n)), "")), tree(STYLE_PART))
    blank, counted, out = re.compile(X.BLANK.replace(X.WS, r"\s")), 0, []
    for number, paragraph in enumerate(tree(MAIN_PART).iter(f"{_W}p"), 1):
        properties = paragraph.find(f"{_W}pPr")
        style = "" if properties is None else _attr(properties.find(f"{_W}pStyle"), "val")
        lines = [["", "", False]]  # text, red text, whether other text came after the red
        for run in _runs(paragraph):
            own = run.find(f"{_W}rPr")
            states = (styles.own(own), styles.inherited("" if own is None else _attr(own.find(f"{_W}rStyle"), "val")), styles.inherited(style), styles.default)
            is_red = next((s for s in states if s is not None), False)
            for k, piece in enumerate(re.sub(r"\r\n?", "\n", _said(run)).split("\n")):
                if k:
                    lines.append(["", "", False])
                line = lines[-1]
                line[0] += piece
                if is_red:
                    if line[1] and line[2] and not line[1].endswith(" "):
                        line[1] += " "
                    line[1] += piece
                    line[2] = False
                elif piece and line[1]:
                    line[2] = True
        listed = properties is not None and properties.find(f".//{_W}numPr") is not None
        for k, (text, marked, _) in enumerate(lines):
            text = _tidy(text)
            if not text:
                continue
            if listed and not k and blank.search(text):
                counted += 1
                text = f"{counted}. {text}"
            out.append((text, _tidy(marked) or None, f"第 {number} 段"))
    return out


def read_docx(files: DataFrame) -> DataFrame:
    """Tagged lines (path, line_no, text, red_text, location, problem) of files with ``path`` and ``content``.

    A file that can't be read gives one row with its problem.
    """

    def decode(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, k, *line, None) for k, line in enumerate(docx_lines(bytes(content)))]
                except (ValueError, ElementTree.ParseError) as e:
                    rows.append((path, 0, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "line_no", "text", "red_text", "location", "problem"])

    return files.select("path", "content").mapInPandas(decode, "path string, line_no int, text string, red_text string, location string, problem string")
