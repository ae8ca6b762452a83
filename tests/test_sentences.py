from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from epistola import catalog
from epistola.functions import stems
from epistola.functions.text import clean_text
from epistola.operators import sentences

#: Words of the published rule examples, step by step, and their stems after all steps.
RULES = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "caress": "caress", "cats": "cat", "flies": "fli", "dies": "die", "mules": "mule",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "denied": "deni", "died": "die", "owned": "own", "humbled": "humbl",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "enjoy": "enjoy", "by": "by", "say": "say",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic",
    "differentli": "differ", "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "geology": "geolog", "nationally": "nation",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "payments": "payment", "delays": "delay", "obligations": "oblig", "submission": "submiss",
}


def test_stems_rule_by_rule(spark):
    assert {w: stems.stem(w) for w in RULES} == RULES
    assert [stems.measure(w) for w in ("tr", "ee", "tree", "y", "by", "trouble", "oats", "trees", "ivy", "troubles", "private", "oaten", "syzygy")] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 2]
    made = spark.createDataFrame([(["payments", None, "é", ""],), (None,), ([],)], "w array<string>").select(stems.stems(__import__("pyspark").sql.functions.col("w")).alias("s")).collect()
    assert [r.s for r in made] == [["payment", None, "é", ""], None, []]


TEXTS = [
    "We refer to letter No. 5 of the contract. The works of Acme Ltd. began late. It is noted.", "See No. 17 and No. 9 for the delay. The claim of Bond Ltd. was filed on 3. May in time! Is it known? Yes.",
    "Acme Ltd. paid. The sum was 5. The rest follows. Mr. J. Smith signed No. 4 for Acme Ltd. as agreed. We paid the sum. The works ended.", "", None, "without any stop", "Mr. Brown met Mr. Gray. The site was wet. The crew left.",
    "It was late and the delay grew while the wet crew left the site",
]


def brute_model(texts):
    edge = re.compile(r"""^["'-]+|["',;:-]+$""")
    pairs = []
    for text in texts:
        bodies = [edge.sub("", t) for t in (text or "").split(" ") if t]
        kinds = ["##number##" if re.match(r"^-?[0-9][0-9.,]*$", b) else (b[:-1] if b.endswith(".") else b).lower() for b in bodies]
        pairs += [(b, k, b.endswith("."), kinds[i + 1] if i + 1 < len(kinds) else None) for i, (b, k) in enumerate(zip(bodies, kinds, strict=True))]
    total, stop = Counter(k for _, k, _, _ in pairs), Counter(k for _, k, s, _ in pairs if s)
    n, stops = len(pairs), sum(s for _, _, s, _ in pairs)

    def log(k, x):
        return k * math.log(x) if k else 0.0

    def together(a, b, ab):
        apart = log(ab, b / n) + log(a - ab, 1 - b / n) + log(b - ab, b / n) + log(n - a - b + ab, 1 - b / n)
        near = 0 if a == ab else log(ab, ab / a) + log(a - ab, 1 - ab / a)
        far = 0 if b == ab else log(b - ab, (b - ab) / (n - a)) + log(n - a - b + ab, 1 - (b - ab) / (n - a))
        return -2 * (apart - near - far)

    short = set()
    for k, with_stop in stop.items():
        if k != "##number##" and re.search(r"\w", k):
            free = total[k] - with_stop
            ratio = -2 * (with_stop * math.log(stops / n) + free * math.log(1 - stops / n) - with_stop * math.log(0.99) - free * math.log(0.01))
            letters = len(k.replace(".", ""))
            if ratio * math.exp(-letters) * (k.count(".") + 1) * letters**-free >= 0.3:
                short.add(k)
    breaks = sum(s and k not in short for _, k, s, _ in pairs)
    first = Counter(x for _, k, s, x in pairs if s and k not in short and x)
    starters = {x for x, ab in first.items() if x != "##number##" and re.search(r"\w", x) and n / breaks > total[x] / ab and together(breaks, total[x], ab) >= 30}
    tied = Counter((k, x) for b, k, s, x in pairs if s and x and (k in short or re.match(r"^[^\W\d_]\.$", b) or k == "##number##"))
    tied = {(k, x) for (k, x), ab in tied.items() if ab > 1 and re.search(r"\w", x) and x not in starters and n / total[k] > total[x] / ab and together(total[k], total[x], ab) >= 7.88}
    return short, starters, tied


@pytest.mark.parametrize("times", [1, 40])
def test_the_model_equals_a_plain_trainer(spark, times):
    r = random.Random(times)
    words = ["the", "works", "site", "a", "of", "crew"]
    texts = TEXTS * times + [" ".join(r.choice([*words, "No. 3", "art. IV", "etc."]) for _ in range(30)).capitalize() + ". The end." for _ in range(times)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    cleaned = [x.c for x in docs.select(clean_text(docs["text"]).alias("c")).collect()]
    known = sentences.model(sentences.learn(docs))
    assert (known.abbreviations, known.starters, known.collocations) == brute_model(cleaned)


def test_a_model_keeps_all_that_passes(spark):
    """52,900 abbreviations: no number of entries is the most that a model holds."""
    letters = [chr(0x4E00 + i) for i in range(230)]
    texts = [" ".join(f"{a}{b}. the long delay" for b in letters) for a in letters]
    learned = sentences.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    short, starters, tied = brute_model(texts)
    got = learned.select("kind", "type", "next").collect()
    assert len(short) == 52_900 and len(got) == len(set(got)) == len(short) + len(starters) + len(tied)
    known = sentences.model(learned)
    assert (known.abbreviations, known.starters, known.collocations) == (short, starters, tied)


def test_abbreviations_do_not_cut(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS * 40], "text string")
    known = sentences.model(sentences.learn(docs))
    assert {"no", "ltd", "mr"} <= known.abbreviations and "the" in known.starters
    found = {x.text: x.s for x in docs.distinct().select("text", sentences.splitter(known)(docs["text"]).alias("s")).collect()}
    assert found[TEXTS[0]] == ["We refer to letter No. 5 of the contract.", "The works of Acme Ltd. began late.", "It is noted."]
    assert found[TEXTS[1]][0] == "See No. 17 and No. 9 for the delay." and found[TEXTS[1]][-2:] == ["Is it known?", "Yes."]
    assert found[TEXTS[6]] == ["Mr. Brown met Mr. Gray.", "The site was wet.", "The crew left."] or found[TEXTS[6]][0].startswith("Mr. Brown met Mr. Gray.")
    assert found[""] == [] and found[None] == [] and found["without any stop"] == ["without any stop"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert sentences.learn(none).count() == 0 and sentences.model(sentences.learn(none)).starters == frozenset()


def test_learning_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(t,) for t in TEXTS * 40], "text string")
    assert sentences.learn(docs.mapInArrow(seen, "text string")).count() > 0
    assert read.value == docs.count()


ODD = [
    "The works ended etc.; The crew left. 5.; Then we paid. 5.: then no more, a.- The end.' And 'so.\" It \"was.\", Yes", "no.; No.- \u2167 was met. \u2167 was not. \u01c5 came? \u01c5 went! now", ". . ! ? ?! Wait... What? 'No.' \"-The rest",
    "-5. The sum. -5. the sum. 5,0. Sum", "\u0130. \u0130stanbul was wet. \u0130 a. B. c. D", "? ! .", "-", "a.b. A.B. a.b. The c.d. the", "   ", "One.", "\u00e9. \u00c9t\u00e9. \u00e9t\u00e9. \u00df. Then", "Is it? yes! no? No.",
]


def _equals_sql(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    made = sorted(tuple(r) for r in catalog.QUERIES["learned_sentences"](spark, str(folder)).select("doc_id", "place", "sentence").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert made == sorted(con.sql(f"select doc_id, place, sentence from ({catalog.ORACLES['learned_sentences']})").fetchall())
    return made


@pytest.mark.parametrize("held", [150_000, 0])
def test_texts_meet_a_model_of_any_size(spark, tmp_path, monkeypatch, held):
    """Equal to the SQL whether tasks hold the model or it is joined; a large one never comes to the driver."""
    monkeypatch.setattr(sentences, "HELD_ROWS", held)
    if not held:
        monkeypatch.setattr(sentences, "model", None)
    made = _equals_sql(spark, tmp_path, TEXTS * 40 + ODD * 3)
    assert (4, 1, None) not in made and any(s.endswith("etc.;") for _, _, s in made)


@pytest.mark.parametrize("held", [150_000, 1_000])
def test_every_abbreviation_counts(spark, tmp_path, monkeypatch, held):
    """52,900 abbreviations, none of which ends a sentence."""
    monkeypatch.setattr(sentences, "HELD_ROWS", held)
    letters = [chr(0x4E00 + i) for i in range(230)]
    assert len(_equals_sql(spark, tmp_path, [" ".join(f"{a}{b}. The long delay" for b in letters) for a in letters])) == 230


def test_split_keeps_rows_and_columns(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "One came. Two left.", 1), (7, "One came. Two left.", 2), (7, None, 3), (7, "", 4), (8, "Only one", 5)], "doc_id long, text string, n int")
    learned = sentences.learn(docs).cache()
    held = sorted(sentences.split(docs, learned).collect(), key=lambda r: r.n)
    monkeypatch.setattr(sentences, "HELD_BYTES", -1)
    joined = sentences.split(docs, learned)
    assert joined.columns == [*docs.columns, "sentences"] and sorted(joined.collect(), key=lambda r: r.n) == held
    assert [r.sentences for r in held] == [["One came.", "Two left."]] * 2 + [[], [], ["Only one"]]
