"""Geometry of decoded pages: red marks, items under marks and highlights, rows of text.

Marks and rows come from interpreters whose state runs through a page, so a page is
one group. The joins between marks, highlights and items carry the page as an equality
and keep the geometry as a residual condition.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import fixed as X
from ..functions import text as T

_IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def numbers(value) -> list[float]:
    """All numbers in a nested list."""
    if isinstance(value, bool) or value is None:
        return []
    if isinstance(value, (int, float)):
        return [float(value)]
    return [n for v in value for n in numbers(v)] if isinstance(value, list) else []


def colour(args) -> tuple[float, float, float]:
    head = args[0] if isinstance(args, list) and args else args
    if isinstance(head, str) and re.fullmatch("#[0-9a-fA-F]{6}", head):
        return tuple(int(head[k : k + 2], 16) for k in (1, 3, 5))
    return tuple((numbers(args) + [0.0] * 3)[:3])


def red(rgb) -> bool:
    r, g, b = (int((x * 255 if x <= 1 else x) + 0.5) for x in rgb)
    return r >= X.RED_MIN and max(g, b) <= X.RED_OTHER_MAX and r >= X.RED_DOMINANCE * g and r >= X.RED_DOMINANCE * b


def glyphs(value) -> str:
    if isinstance(value, str):
        return value
    out = []
    for g in value if isinstance(value, list) else ():
        if isinstance(g, str):
            out.append(g)
        elif isinstance(g, (int, float)):
            out.append(" " if g < X.KERNING_SPACE else "")
        elif isinstance(g, dict):
            out.append(g.get("unicode") or "")
    return "".join(out)


class Graphics:
    """The part of a page's graphics state that decides where red text stands."""

    KEPT = ("fill", "ctm", "text", "leading", "rise")

    def __init__(self, names: dict[int, str]):
        self.names, self.saved, self.marks = names, [], []
        self.fill, self.ctm, self.text, self.leading, self.rise = (0.0, 0.0, 0.0), _IDENTITY, _IDENTITY, 0.0, 0.0

    def run(self, code: int, args) -> None:
        name = self.names.get(code)
        handler = getattr(self, f"on_{name}", None)
        if handler:
            handler(args)
        if name in ("nextLine", "nextLineShowText", "nextLineSetSpacingShowText"):
            self.move(0, -self.leading)
        if name in ("showText", "showSpacedText", "nextLineShowText", "nextLineSetSpacingShowText"):
            operands = args if isinstance(args, list) else [args]
            at = 2 if name == "nextLineSetSpacingShowText" else 0
            self.show(operands[at] if len(operands) > at else "")

    def on_save(self, _):
        self.saved.append([getattr(self, k) for k in self.KEPT])

    def on_restore(self, _):
        if self.saved:
            for k, v in zip(self.KEPT, self.saved.pop()):
                setattr(self, k, v)

    def on_transform(self, args):
        m = numbers(args)
        if len(m) >= 6:
            a, b, c, d, e, f = self.ctm
            self.ctm = (a * m[0] + c * m[1], b * m[0] + d * m[1], a * m[2] + c * m[3], b * m[2] + d * m[3], a * m[4] + c * m[5] + e, b * m[4] + d * m[5] + f)

    def on_setFillRGBColor(self, args):
        self.fill = colour(args)

    def on_setFillGray(self, args):
        self.fill = (numbers(args) + [0.0])[:1] * 3

    def on_setFillCMYKColor(self, args):
        c, m, y, k = [x / 255 if x > 1 else x for x in (numbers(args) + [0.0] * 4)[:4]]
        self.fill = tuple(255 * (1 - min(1.0, x * (1 - k) + k)) for x in (c, m, y))

    def on_beginText(self, _):
        self.text = _IDENTITY

    def on_setTextMatrix(self, args):
        m = numbers(args)
        if len(m) >= 6:
            self.text = tuple(m[:6])

    def move(self, x, y):
        self.text = (*self.text[:4], self.text[4] + x, self.text[5] + y)

    def on_moveText(self, args):
        self.move(*(numbers(args) + [0.0, 0.0])[:2])

    def on_setLeadingMoveText(self, args):
        self.on_moveText(args)
        self.leading = -(numbers(args) + [0.0, 0.0])[1]

    def on_setLeading(self, args):
        self.leading = (numbers(args) + [0.0])[0]

    def on_setTextRise(self, args):
        self.rise = (numbers(args) + [0.0])[0]

    def show(self, value):
        said = glyphs(value).strip()
        if said and red(self.fill):
            x, y = self.text[4], self.text[5] + self.rise
            a, b, c, d, e, f = self.ctm
            self.marks.append((said, a * x + c * y + e, b * x + d * y + f))


def red_marks(ops: DataFrame, codes: dict[str, int]) -> DataFrame:
    """Red text marks (doc_id, page, mark, text, x, y) of operator lists (doc_id, page, seq, fn, args as JSON)."""
    names = {v: k for k, v in codes.items()}

    def interpret(page: pd.DataFrame) -> pd.DataFrame:
        g = Graphics(names)
        for row in page.sort_values("seq").itertuples():
            g.run(row.fn, json.loads(row.args) if row.args else None)
        head = page.iloc[0]
        return pd.DataFrame([(head.doc_id, head.page, k, *m) for k, m in enumerate(g.marks)], columns=["doc_id", "page", "mark", "text", "x", "y"])

    return ops.groupBy("doc_id", "page").applyInPandas(interpret, "doc_id bigint, page int, mark int, text string, x double, y double")


def positioned(items: DataFrame) -> DataFrame:
    """Text items (doc_id, page, idx, str, transform, width, height) with x, y and height; incomplete ones dropped."""
    number = lambda c: F.coalesce(c, F.lit(0.0))
    return items.where((F.coalesce("str", F.lit("")) != "") & (F.size("transform") >= 6)).select(
        "doc_id",
        "page",
        "idx",
        F.col("str").alias("text"),
        number(F.col("transform")[4]).alias("x"),
        number(F.col("transform")[5]).alias("y"),
        F.greatest(F.lit(0.0), number(F.col("width"))).alias("width"),
        F.greatest(F.lit(0.0), F.coalesce(F.nullif(F.col("height"), F.lit(0.0)), F.abs(number(F.col("transform")[3])))).alias("height"),
    )


def nearest_items(marks: DataFrame, items: DataFrame) -> DataFrame:
    """The item each mark lies on: least 3 dy + dx + penalty for other text, first among equals, below the limit."""
    m, i = marks.alias("m"), items.alias("i")
    dy = F.abs(F.col("i.y") - F.col("m.y"))
    right = F.col("i.x") + F.col("i.width")
    reach = F.greatest(F.lit(2.5), F.col("i.height") * 0.45)
    near = (dy <= F.greatest(F.lit(2.5), F.col("i.height") * 0.55)) & (F.col("m.x") >= F.col("i.x") - reach) & (F.col("m.x") <= right + reach) & (T.trim(F.col("i.text")) != "")
    bare = lambda c: F.lower(T.sub(F.col(c), f"{X.WS}+"))
    a, b = bare("m.text"), bare("i.text")
    penalty = F.when((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), 0).otherwise(X.MARK_TEXT_PENALTY)
    dx = F.greatest(F.lit(0.0), F.col("i.x") - F.col("m.x"), F.col("m.x") - right)
    score = dy * X.MARK_Y_WEIGHT + dx + penalty
    same = (F.col("m.doc_id") == F.col("i.doc_id")) & (F.col("m.page") == F.col("i.page"))
    joined = m.join(i, same & near).select("m.doc_id", "m.page", "m.mark", score.alias("score"), "i.idx")
    best = joined.groupBy("doc_id", "page", "mark").agg(F.min(F.struct("score", "idx")).alias("b"))
    return best.where(F.col("b.score") < X.MARK_MAX_SCORE).select("doc_id", "page", "mark", F.col("b.idx").alias("idx"), F.col("b.score").alias("score"))


def highlight_rectangles(annotations: DataFrame) -> DataFrame:
    """Rectangles of red highlights (doc_id, page, subtype, color, quadPoints, rect): a quad each, or else the rect."""
    c = F.col("color")
    marked = annotations.where((F.col("subtype") == "Highlight") & T.is_red(F.coalesce(F.get(c, 0), F.lit(0.0)), F.coalesce(F.get(c, 1), F.lit(0.0)), F.coalesce(F.get(c, 2), F.lit(0.0))))
    q = F.col("quadPoints")
    starts = F.when(F.size(q) >= 8, F.sequence(F.lit(0), F.size(q) - 8, F.lit(8))).otherwise(F.array().cast("array<int>"))
    pick = lambda k, off: F.array(*[F.get(q, k + off + 2 * j) for j in range(4)])
    box = lambda xs, ys: F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
    quads = F.transform(starts, lambda k: box(pick(k, 0), pick(k, 1)))
    r = F.col("rect")
    single = F.when(F.size(r) >= 4, F.array(box(F.array(r[0], r[2]), F.array(r[1], r[3])))).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))
    return marked.select("doc_id", "page", F.explode(F.when(F.coalesce(F.size(q), F.lit(0)) >= 8, quads).otherwise(single)).alias("b")).select("doc_id", "page", "b.*")


def items_under(rectangles: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct items that a rectangle of their page touches."""
    r, i = rectangles.alias("r"), items.alias("i")
    over = (
        (F.col("i.x") + F.greatest(F.col("i.width"), F.col("i.height") * 0.4) >= F.col("r.x1"))
        & (F.col("i.x") <= F.col("r.x2"))
        & (F.col("i.y") + F.col("i.height") * 0.3 >= F.col("r.y1"))
        & (F.col("i.y") - F.col("i.height") <= F.col("r.y2"))
    )
    return i.join(r, (F.col("i.doc_id") == F.col("r.doc_id")) & (F.col("i.page") == F.col("r.page")) & over, "left_semi").select("doc_id", "page", "idx")


def assemble(row: list[tuple], red_only: bool) -> str:
    """Text of a row's items (x, text, width, height, red) from left to right, spaces where there are gaps."""
    out, end, high, gap_due = "", None, 0.0, False
    for x, said, width, height, is_red in sorted(row, key=lambda i: i[0]):
        said = re.sub(r"\s+", " ", said)
        if not said.strip():
            gap_due = True
            continue
        if red_only and not is_red:
            gap_due = gap_due or bool(out)
            continue
        wide = max(1.2, min(high or height or 6, height or high or 6) * 0.22)
        if out and not out.endswith(" ") and (gap_due or (end is not None and x - end > wide)):
            out += " "
        out += said.strip()
        end, high, gap_due = x + max(width, height * 0.25), height or high, False
    return re.sub(r"[ \t]+", " ", out).strip()


def page_lines(items: DataFrame) -> DataFrame:
    """Lines (doc_id, page, line_no, text, red_text) of positioned items with a ``red`` flag.

    Items join the first row whose running mean height on the page is near enough.
    """

    def cluster(page: pd.DataFrame) -> pd.DataFrame:
        rows: list[dict] = []
        for i in page.sort_values(["y", "x", "idx"], ascending=[False, True, True], kind="stable").itertuples():
            for row in rows:
                if abs(row["y"] - i.y) <= max(2.5, min(row["h"] or i.height or 8, i.height or row["h"] or 8) * 0.24):
                    break
            else:
                row = {"y": i.y, "h": i.height, "items": []}
                rows.append(row)
            row["items"].append((i.x, i.text, i.width, i.height, bool(i.red)))
            n = len(row["items"])
            row["y"] = (row["y"] * (n - 1) + i.y) / n
            row["h"] = max(row["h"], i.height)
        rows.sort(key=lambda r: -r["y"])
        head, out = page.iloc[0], []
        for r in rows:
            said = assemble(r["items"], False)
            if said:
                out.append((head.doc_id, head.page, len(out), said, assemble(r["items"], True) or None))
        return pd.DataFrame(out, columns=["doc_id", "page", "line_no", "text", "red_text"])

    return items.groupBy("doc_id", "page").applyInPandas(cluster, "doc_id bigint, page int, line_no int, text string, red_text string")


def tagged_lines(items: DataFrame, ops: DataFrame, codes: dict[str, int], annotations: DataFrame | None = None) -> DataFrame:
    """Decoded pages to tagged lines: marks, highlights, rows."""
    placed = positioned(items)
    hit = nearest_items(red_marks(ops, codes), placed).select("doc_id", "page", "idx")
    if annotations is not None:
        hit = hit.unionByName(items_under(highlight_rectangles(annotations), placed))
    flagged = placed.join(hit.distinct().withColumn("red", F.lit(True)), ["doc_id", "page", "idx"], "left").withColumn("red", F.coalesce("red", F.lit(False)))
    return page_lines(flagged)


def within_limits(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, problem): documents of more pages than the limit are refused."""
    sizes = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    return sizes.withColumn("problem", F.when(F.col("pages") > X.MAX_PAGES, F.lit("too many pages")))


def raster_scale(width: Column, height: Column) -> Column:
    """How far a page is enlarged for recognition: twice, or less to stay within the pixel limit."""
    area = F.greatest(F.lit(1.0), (width * height).cast("double"))
    return F.greatest(F.lit(X.MIN_RASTER_SCALE), F.least(F.lit(X.MAX_RASTER_SCALE), F.sqrt(F.lit(float(X.MAX_RASTER_PIXELS)) / area)))


def pages_to_read(pages: DataFrame) -> DataFrame:
    """Pages (.., red_ratio, text, red_text) whose red share is worth a recognition, with
    ``whole``: whether the page is to be read whole, as its text layer is nearly empty."""
    short = F.length(T.key(F.coalesce("text", F.lit("")))) < X.OCR_PAGE_CHARS
    lines = F.size(T.useful_lines(F.coalesce("red_text", F.lit("")))) > 0
    return pages.where(F.col("red_ratio") >= X.RASTER_MIN_RED).withColumn("whole", short & lines)


@F.pandas_udf(DoubleType())
def red_pixel_ratio(pixels: pd.Series) -> pd.Series:
    """Share of red pixels in RGBA bytes."""
    import numpy as np

    def share(raw):
        if not raw:
            return 0.0
        p = np.frombuffer(raw, np.uint8).reshape(-1, 4).astype(float)
        r, g, b = p[:, 0], p[:, 1], p[:, 2]
        return float(((r >= X.RED_MIN) & (g <= X.RED_OTHER_MAX) & (b <= X.RED_OTHER_MAX) & (r >= X.RED_DOMINANCE * g) & (r >= X.RED_DOMINANCE * b)).mean())

    return pixels.map(share)
