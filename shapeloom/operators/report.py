"""Reports of routes as Markdown: one text column for each route, built from its sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headings and sentences of the report.
ITEMS = ("圖形", "行政區", "級距", "里程", "起終點", "綜合評分")
SECTIONS = ("## 一、評分（依規格書第二節權重）", "## 二、路名循序導航表（Cue Sheet）", "## 三、安全提醒", "## 四、地標打卡點")
TABLES = ("| 構面 | 權重 | 得分 |", "| # | 累計 km | 動作 | 路名 | 該段長度 |", "| 累計 km | 類別 | 提醒 |", "| 累計 km | 地標 | 類型 | 距路線 |")
NO_NOTES, NO_MARKS = "沿線未偵測到需特別標記的路段。", "沿線 180 公尺內未找到具名地標，建議手動指定。"
FOOTER = ("---", "資料來源：OpenStreetMap 貢獻者（ODbL）；高程 Open-Meteo。", "本表由圖形路跑路線規劃系統自動產生，實跑前請再以現場狀況確認。")


def _table(heading: str, lines: Column, empty: str | None = None) -> Column:
    """A table under its heading; a sentence instead where it has no lines."""
    rule = "|" + "---|" * (heading.count("|") - 1)
    full = F.concat_ws("\n", F.lit(heading), F.lit(rule), lines)
    return full if empty is None else F.when(F.size(lines) > 0, full).otherwise(F.lit(empty))


def _lines(rows: DataFrame, key: str, order: Column, line: Column, name: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("s"))))
    return rows.groupBy(key).agg(F.transform(listed, lambda x: x["s"]).alias(name))


def markdown_report(routes: DataFrame, cues: DataFrame, notes: DataFrame, marks: DataFrame) -> DataFrame:
    """(route, report): a report for each row of ``routes``.

    routes: (route, title, shape, district, level, km, lat, lon, total, parts), parts an array of (label, weight,
    score, detail), detail an array of (name, value). cues: (route, seq, km, action, road, len_m). notes: (route, ord,
    km, type, text). marks: (route, ord, km, name, kind, dist_m), of which the first three are shown. A route without
    notes or marks says so. A route's rows are few; they meet by the route's key.
    """
    cue = _lines(cues, "route", F.col("seq"), F.format_string("| %d | %.2f | %s | %s | %d m |", "seq", "km", "action", "road", "len_m"), "cues")
    note = _lines(notes, "route", F.col("ord"), F.format_string("| %.2f | %s | %s |", "km", "type", "text"), "notes")
    mark = _lines(marks, "route", F.col("ord"), F.format_string("| %.2f | %s | %s | %d m |", "km", "name", "kind", "dist_m"), "marks")
    none = F.array().cast("array<string>")
    cue_lines, note_lines, mark_lines = (F.coalesce(c, none) for c in ("cues", "notes", "marks"))
    values = (
        F.col("shape"), F.col("district"), F.col("level"), F.format_string("%.2f km", "km"), F.format_string("%.6f, %.6f", "lat", "lon"), F.format_string("**%.1f / 100**", "total"),
    )
    facts = F.array(*(F.concat(F.lit(f"| {name} | "), value, F.lit(" |")) for name, value in zip(ITEMS, values, strict=True)))
    scores = F.transform("parts", lambda p: F.format_string("| %s | %d%% | %.1f |", p["label"], p["weight"], p["score"]))
    details = F.transform("parts", lambda p: F.concat(F.lit("**"), p["label"], F.lit("**\n\n"), F.array_join(F.transform(p["detail"], lambda d: F.concat(d["name"], F.lit("："), d["value"])), " ／ "), F.lit("\n")))
    report = F.concat_ws(
        "\n", F.concat(F.lit("# "), "title", F.lit("\n")), _table("| 項目 | 內容 |", facts), F.lit(f"\n{SECTIONS[0]}\n"), _table(TABLES[0], scores), F.lit(""), details,
        F.lit(f"{SECTIONS[1]}\n"), _table(TABLES[1], cue_lines), F.lit(f"\n{SECTIONS[2]}\n"), _table(TABLES[2], note_lines, NO_NOTES),
        F.lit(f"\n{SECTIONS[3]}\n"), _table(TABLES[3], F.slice(mark_lines, 1, 3), NO_MARKS), F.lit(f"\n{FOOTER[0]}\n"), F.lit("\n".join(FOOTER[1:])),
    )
    return routes.join(cue, "route", "left").join(note, "route", "left").join(mark, "route", "left").select("route", report.alias("report"))
