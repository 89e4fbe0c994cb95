"""Reading questions: anchors, structure, terms, candidates, lenient JSON."""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tolerant_json

# Fixed values.
COMPARE_WORDS = {"小于等于": "≤", "不超过": "≤", "大于等于": "≥", "不低于": "≥", "至少": "≥", "小于": "<", "低于": "<", "大于": ">", "高于": ">", "超过": ">"}
NUMBER = r"\d+(?:\.\d+)?"
UNIT = r"(?:μg|mcg|mg|g|ml|mL|l|L|%|次/年|次|/μL|/uL|ml/min|mL/min)"
TOKEN = r"[A-Za-z][A-Za-z0-9]*"
SYMBOL = rf"{TOKEN}(?:[+/_.-]{TOKEN}|/[A-Za-z0-9]+)+"
CODE = r"\b(?:[A-Z]{2,}[-_]?\d+[A-Z0-9_-]*|[A-Za-z]+-\d+[A-Za-z0-9_-]*|\d+(?:\.\d+){1,3}|ERR[-_ ]?[A-Za-z0-9_-]+)\b"
ENDINGS = r"(?:是什么|是多少|有哪些|怎么办|如何|怎么|是否正确|是否|吗|呢)+$"
INTENTS = (
    ("禁忌|禁用|不能用|不宜", "禁忌"), ("首选|推荐|应该用|选择", "推荐"), ("替代|改用|换用|过敏", "替代"), ("疗程|持续|多久|多长", "疗程"),
    ("剂量|目标剂量|滴定|多少mg", "剂量"), ("副作用|不良反应|导致|引起", "副作用"), ("比较|优势|劣势|区别|差异", "比较"), ("目标|目标值|控制目标|范围", "目标值"),
    ("如何处理|怎么办|处理", "处理"), ("诊断|标准|诊断标准", "诊断"), ("机制|原理|为什么", "机制"),
)
TYPE_PATTERNS = (
    ("[一-鿿A-Za-z0-9+-]{1,20}(?:类药物|类利尿剂|利尿剂|抑制剂|阻滞剂|激动剂|拮抗剂|单抗|药物)", "DrugClass"),
    ("[一-鿿A-Za-z0-9+-]{1,24}(?:治疗|疗法|方案|双抗|抗凝|抗血小板治疗)", "Therapy"),
    ("[一-鿿A-Za-z0-9+-]{1,24}(?:支架|植入术|造影|检查)", "Device"),
)
STRONG = ("quoted", "threshold", "symbolic", "numeric")

#: kind, pattern, what of a match becomes the anchor, whether a covered match counts, whether a match covers.
RULES = (
    ("quoted", re.compile("[\"“”'‘’]([^\"“”'‘’]+)[\"“”'‘’]"), lambda m: m[1], True, True),
    ("threshold", re.compile(rf"(?:{SYMBOL}|{TOKEN})\s*(?:<=|>=|<|>|≤|≥|=)\s*{NUMBER}", re.I), lambda m: m[0], True, True),
    ("threshold", re.compile(rf"({SYMBOL}|{TOKEN})\s*({'|'.join(COMPARE_WORDS)})\s*({NUMBER})", re.I), lambda m: f"{m[1]} {COMPARE_WORDS[m[2]]} {m[3]}", True, True),
    ("symbolic", re.compile(SYMBOL, re.I), lambda m: m[0], True, True),
    ("numeric", re.compile(rf"{NUMBER}\s*{UNIT}", re.I), lambda m: m[0], True, True),
    ("numeric", re.compile(rf"(?:每日|每周|每月|每年|每天)?\s*{NUMBER}\s*次"), lambda m: m[0], True, True),
    ("symbolic", re.compile(CODE, re.I), lambda m: m[0], False, True),
    ("phrase", re.compile("[一-鿿]{2,}"), lambda m: re.sub(ENDINGS, "", m[0]).strip(" ，,。？?:："), False, False),
)


def anchors(question: str) -> list[tuple[str, str]]:
    """(text, kind) of a question's anchors; later rules skip what earlier ones cover."""
    found: dict[tuple[str, str], tuple[str, str]] = {}
    covered: list[tuple[int, int]] = []
    for kind, pattern, text_of, even_covered, covers in RULES:
        for m in pattern.finditer(question):
            inside = any(a <= m.start() and m.end() <= b for a, b in covered)
            if inside and not even_covered:
                continue
            text = " ".join(text_of(m).split())
            if text:
                found.setdefault((text.casefold(), kind), (text, kind))
            if covers and not inside:
                covered.append(m.span())
    return list(found.values())


def question_anchors(questions: DataFrame, text_col: str = "text") -> DataFrame:
    """F9, FLT11: ``questions`` with anchors and strong (an anchor of a form, not only a phrase)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [[{"text": t, "kind": k} for t, k in anchors(q or "")] for q in f[text_col]]
            yield f.assign(anchors=rows, strong=[any(a["kind"] in STRONG for a in r) for r in rows])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in questions.schema)
    return questions.mapInPandas(run, f"{names}, anchors array<struct<text:string,kind:string>>, strong boolean")


def entity_type(text: Column) -> Column:
    """the type cascade."""
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    out = F.when(holds(("疾病", "病", "COPD")), "Disease").when(holds(("利尿剂", "沙坦", "普利", "列净", "单抗")), "DrugClass").when(holds(("检查", "指标", "水平", "eGFR", "HbA1c")), "Test").otherwise("Procedure")
    for pattern, kind in reversed(TYPE_PATTERNS):
        out = F.when(text.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def relation_intent(text: Column) -> Column:
    """the first intent whose words occur, else empty."""
    out = F.lit("")
    for pattern, intent in reversed(INTENTS):
        out = F.when(text.rlike(pattern), intent).otherwise(out)
    return out


# Focus tokens, words that are none, and constraints of a question.
FOCUS_TOKEN = "[\\u4e00-\\u9fff]{2,}|[A-Z][A-Za-z0-9_-]*(?:\\s+[A-Z][a-z]+)*|[A-Z]{2,}[-]?\\d*"
FOCUS_STOPS = ("患者", "治疗", "使用", "应该", "如何", "什么", "多少", "哪些")
CONSTRAINT = "(?:[<>≤≥]=?\\s*\\d+(?:\\.\\d+)?)|(?:\\d+(?:\\.\\d+)?\\s*(?:mg|ml|mmol|pg|g/L|%|次|分|期|级))"


def question_structure(text: Column) -> Column:
    """struct(focus, background, constraints, intent); the first two entity tokens are the focus."""
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(FOCUS_TOKEN), F.lit(0)))
    tokens = F.array_except(tokens, F.array(*map(F.lit, FOCUS_STOPS)))
    limits = F.regexp_extract_all(text, F.lit(CONSTRAINT), F.lit(0))
    return F.struct(F.slice(tokens, 1, 2).alias("focus"), F.slice(tokens, F.lit(3), F.greatest(F.size(tokens) - 2, F.lit(0))).alias("background"), limits.alias("constraints"), relation_intent(text).alias("intent"))


def distinct_ignoring_case(values: Column) -> Column:
    """Ordered, two characters or more, the first of each folded form."""
    kept = F.filter(values, lambda v: F.length(F.trim(v)) >= 2)
    return F.aggregate(kept, X.no_strings(), lambda acc, v: F.when(F.exists(acc, lambda a: X.fold(a) == X.fold(v)), acc).otherwise(F.concat(acc, F.array(v))))


def expansion_terms(structure: Column) -> Column:
    """Focus, then constraints, then background."""
    return distinct_ignoring_case(F.concat(structure["focus"], structure["constraints"], structure["background"]))


def ranked_candidates(candidates: Column, most: int = 6) -> Column:
    """By number of words descending, then folded text, cut at ``most``."""
    keyed = F.transform(candidates, lambda c: F.struct((-F.size(F.split(c, "\\s+"))).alias("w"), F.lower(c).alias("k"), c.alias("c")))
    return F.slice(F.transform(F.array_sort(keyed), lambda x: x["c"]), 1, most)


def first_object(text: str) -> dict:
    """the first balanced JSON object in a text, fenced or not; an empty one if there is none."""
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            if isinstance(value, dict):
                return value
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return {}


def loose_list(text: str) -> list[str]:
    """items between the first brackets, quotes and blanks stripped."""
    m = re.search(r"\[(.*?)\]", text, re.S)
    return [p for p in (part.strip(" \"'\n") for part in m[1].split(",")) if p] if m else []


def json_segments(text: str) -> list[object]:
    """SRC14: the values of concatenated JSON, whatever stands between them."""
    decoder, out, at = json.JSONDecoder(), [], 0
    while at < len(text):
        start = min((p for p in (text.find("{", at), text.find("[", at)) if p >= 0), default=-1)
        if start < 0:
            break
        try:
            value, at = decoder.raw_decode(text, start)
            out.append(value)
        except ValueError:
            at = start + 1
    return out


def vector_cache_key(vector: list[float], places: int = 4) -> str:
    """MD5 of the rounded vector as big-endian floats."""
    return hashlib.md5(struct.pack(f">{len(vector)}f", *(round(v, places) for v in vector))).hexdigest()


def vector_cache_keys(vectors: DataFrame, id_col: str, places: int = 4) -> DataFrame:
    """F29 over a table: (id, cache_key), rounded and packed by Arrow batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys = [hashlib.md5(np.round(np.asarray(v, np.float64), places).astype(">f4").tobytes()).hexdigest() if v is not None else None for v in f["embedding"]]
            yield pd.DataFrame({id_col: f[id_col], "cache_key": keys})

    return vectors.select(F.col(id_col).cast("long").alias(id_col), "embedding").mapInPandas(run, f"{id_col} long, cache_key string")


def parse_extraction(raw: Column) -> Column:
    """entity and relation lines ``ENTITY: name | type`` and ``RELATIONSHIP: a | r | b`` as arrays of structs."""
    field = lambda line, i: F.trim(F.coalesce(F.try_element_at(F.split(F.regexp_replace(line, "^[A-Z]+:", ""), "\\|"), F.lit(i)), F.lit("")))
    lines = F.transform(F.split(raw, "\n"), lambda x: F.trim(x))
    entities = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("ENTITY:"))), lambda x: F.struct(field(x, 1).alias("name"), field(x, 2).alias("entity_type")))
    relations = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("RELATIONSHIP:"))), lambda x: F.struct(field(x, 1).alias("source"), field(x, 2).alias("relation_type"), field(x, 3).alias("target")))
    return F.struct(F.filter(entities, lambda e: e["name"] != "").alias("entities"), F.filter(relations, lambda r: (r["source"] != "") & (r["target"] != "")).alias("relations"))


def salvage(rows: DataFrame, text_col: str, schema: str) -> DataFrame:
    """``rows`` with value: the first balanced JSON object in a model's answer, read by ``schema`` (null if there is none)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [first_object(t or "") for t in f[text_col]]
            yield f.assign(__json=[json.dumps(v) if v else None for v in found])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{names}, __json string").withColumn("value", F.from_json("__json", schema)).drop("__json")


def repaired(rows: DataFrame, text_col: str, key: str | None = None) -> DataFrame:
    """``rows`` with json and how (strict, repaired or none); with ``key``, json is the list under it."""
    keep = [c for c in rows.columns if c not in ("json", "how")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [tolerant_json.parse(t or "") for t in f[text_col]]
            values = [tolerant_json.listed(t or "", key) for t in f[text_col]] if key else [v for v, _ in found]
            yield f[keep].assign(json=[None if how == "none" and not key else json.dumps(v, ensure_ascii=False) for v, (_, how) in zip(values, found, strict=True)], how=[how for _, how in found])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    return rows.mapInPandas(run, f"{names}, json string, how string")


def segments(rows: DataFrame, text_col: str) -> DataFrame:
    """SRC14: the rows' other columns with (place, segment): one row per JSON value in a text, whatever stands between them."""
    keep = [c for c in rows.columns if c != text_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            listed = f.assign(__s=[[json.dumps(v) for v in json_segments(t or "")] for t in f[text_col]])
            parts = listed[[*keep, "__s"]].explode("__s").dropna(subset=["__s"]).rename(columns={"__s": "segment"})
            yield parts.assign(place=parts.groupby(level=0).cumcount().astype("int32"))[[*keep, "place", "segment"]]

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text_col)
    return rows.mapInPandas(run, f"{names}, place int, segment string")
