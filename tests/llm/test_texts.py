import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratamem.llm import encodings, leakage, mixing, near_duplicates, truncation
from stratamem.llm.text import words

NOW = datetime.datetime(2026, 1, 1)
rng = random.Random(7)
VOCABULARY = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(600)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(VOCABULARY)
    return " ".join(w)


# near duplicates


def corpus(spark, rows):
    return spark.createDataFrame([(i, "t", b, NOW, "x", 1, "y") for i, b in rows], "rec_id bigint, title string, body string, loaded_at timestamp_ntz, id string, n int, same string")


def jaccard(a, b):
    s = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (words(a), words(b))]
    return len(s[0] & s[1]) / len(s[0] | s[1])


@pytest.mark.parametrize(("shard", "task"), [(2048, 16384), (40, 16384), (2048, 50)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, shard, task):
    monkeypatch.setattr(near_duplicates, "SHARD", shard)
    monkeypatch.setattr(near_duplicates, "TASK_ROWS", task)
    texts = {i: prose(60 + i % 80, i) for i in range(140)}
    texts |= {200 + i: edited(texts[i], 3, i) for i in range(30)}
    texts |= {300: texts[3].upper() + "!!", 301: texts[3], 302: texts[3]}
    rows = [*texts.items(), (1, texts[1]), (400, None), (401, ""), (402, "  \n"), (403, "one two"), (None, texts[5]), (404, prose(40_000, 9))]
    got = {(r.a, r.b) for r in near_duplicates.found_pairs(corpus(spark, rows), "rec_id", "body").collect()}
    ids = sorted(texts)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(texts[a], texts[b]) >= 0.6}
    assert got <= want and len(got) >= len(want) - (1 if shard < 100 else 0)


def test_many_copies_give_all_pairs_and_empty_gives_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "COPY_ROWS", 16)
    text = prose(50, 1)
    near = edited(text, 1, 3)
    df = corpus(spark, [(i, text) for i in range(70)] + [(100, near), (101, near)])
    got = [(r.a, r.b) for r in near_duplicates.found_pairs(df, "rec_id", "body").collect()]
    ids = [*range(70), 100, 101]
    assert sorted(got) == [(a, b) for a in ids for b in ids if a < b]
    rows = near_duplicates.groups(df, "rec_id", "body").collect()
    assert {(r.group_id, r["size"]) for r in rows} == {(0, 72)} and len(rows) == 72
    assert near_duplicates.found_pairs(df.limit(0), "rec_id", "body").count() == 0


# leakage

ITEMS = "item_id bigint, qid string, question_type string, question string, answer string, answer_options array<string>, passage string"
PASSAGE = "The quiet miller of Orlanvar counted seventeen naïve lanterns before the slow bridge was painted by Dunmere in early spring near the mill wheel"


def items(spark, rows=((1, "Which lantern did the miller of Orlanvar leave near the old bridge before dawn when rain fell?", PASSAGE), (2, None, None), (1, "Which lantern did the miller of Orlanvar leave near the old bridge before dawn when rain fell?", PASSAGE))):
    return spark.createDataFrame([(i, "q", None, q, None, None, p) for i, q, p in rows], ITEMS)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, NOW, 1, "w") for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, loaded_at timestamp_ntz, at int, window string")


def test_leaks(spark):
    part = " ".join(PASSAGE.split()[3:16])
    renamed = PASSAGE.replace("Orlanvar", "Zelkomir").replace("Dunmere", "Vastrin").replace("seventeen", "30")
    rows = [(1, "Before. " + PASSAGE.upper().replace(" ", "  \n") + " After.", "s"), (2, "x " + part.replace("naïve", "naive").replace("lanterns", "<i>lan&shy;terns</i>,") + " y", "s"), (3, " ".join(PASSAGE.split()[:11]), "s"), (4, renamed + ". " + renamed, None), (5, None, "s"), (6, "", "s"), (7, "miller " * 30_000, "s"), (1, "Before. " + PASSAGE, "s"), (None, PASSAGE, "s")]
    got = leakage.leaks(documents(spark, rows), items(spark))
    kinds = {(r.doc_id, r.item_id): r.leak for r in got.collect()}
    assert {k for k, v in kinds.items() if v == "verbatim"} == {(1, 1), (2, 1)}
    assert kinds.get((4, 1)) == "renamed"
    report = {r.item_id: (r.leaked, r.documents) for r in leakage.item_report(got, items(spark)).collect()}
    assert report == {1: (True, 2), 2: (False, 0)}
    assert leakage.leaks(documents(spark, rows).limit(0), items(spark)).count() == 0
    assert leakage.leaks(documents(spark, rows), items(spark).limit(0)).count() == 0


QUESTION = "Which lantern did the miller of Orlanvar leave near the old bridge with Dunmere before dawn when rain fell on the roof?"


def test_renamed_short_questions_and_slots_of_a_run(spark):
    assert leakage.RUN < len(leakage.plain_words(QUESTION)) < 2 * leakage.RUN
    short = QUESTION.replace("Orlanvar", "Zelkomir").replace("Dunmere", "Vastrin")
    passage = PASSAGE + " when Kestrel read it to Dunmere"
    # the last slot does not fit, the 29 words before it do
    torn = passage.replace("Orlanvar", "Zelkomir").replace("by Dunmere", "by Vastrin").replace("seventeen", "30").replace("Kestrel", "Falkor").replace("to Dunmere", "to Orlo")
    mixed = QUESTION.replace("Orlanvar", "Vastrin").replace("Dunmere", "Vastrin")
    rows = [(1, short, "s"), (2, torn, "s"), (3, " ".join(short.split()[:11]), "s"), (3, " ".join(short.split()[11:]), "s"), (4, mixed, "s")]
    got = {(r.doc_id, r.item_id): (r.leak, r.template_run) for r in leakage.leaks(documents(spark, rows), items(spark, [(1, QUESTION, None), (2, None, passage)])).collect()}
    assert got == {(1, 1): ("renamed", 22), (2, 2): ("renamed", 29)}


def test_a_template_of_many_items_joins_only_whole_leaks(spark, monkeypatch):
    # 60 items that share most of their template; each is leaked once, half of them with other names
    frame = "In spring the miller {0} counted {1} lanterns near the old mill while the cafe owner {2} painted the slow bridge with {0} and said that {3} would come before rain fell"
    name = lambda k: "".join("bdfglmnprst"[(k // 11**i) % 11] + "aeiou"[(k + i) % 5] for i in range(3)).capitalize()
    text = lambda k: frame.format(name(k), 3 + k, name(500 + k), name(900 + k))
    asked = [(i, None, text(i) + f" on the {'red' if i % 2 else 'blue'} hill") for i in range(60)]
    torn = frame.format("Gora", 9, "Gora", "Tilo")  # two names in one: no item has such slots
    rows = [(i, "x y. " + text(i) + " z", "s") for i in range(60)] + [(100, text(5000), "s"), (101, torn, "s"), (102, "<a title='" + "lantern mill " * 40 + "'>" + text(3).replace("lanterns", "lan<b class='" + "z" * 300 + "'>terns"), "s")]
    got = {(r.doc_id, r.item_id): r for r in leakage.leaks(documents(spark, rows), items(spark, asked)).collect()}
    assert {k for k, r in got.items() if r.leak == "verbatim"} == {(i, i) for i in range(60)} | {(102, 3)}
    assert {k for k in got if k[0] == 100} == {(100, i) for i in range(60)} and not [k for k in got if k[0] == 101]
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 10)
    again = {(r.doc_id, r.item_id): r for r in leakage.leaks(documents(spark, rows), items(spark, asked)).collect()}
    assert again == got
    monkeypatch.setattr(leakage, "ITEM_CHARACTERS", 10)
    with pytest.raises(ValueError, match="ask in parts"):
        leakage.leaks(documents(spark, rows), items(spark, asked))


# mixing


def test_mixture_reaches_its_shares(spark):
    rows = [(i, prose(20 + i % 50, i), ["big", "Mid ", "small"][0 if i % 20 > 5 else 1 if i % 20 else 2]) for i in range(1000)]
    rows += [(2000, None, "big"), (2001, "", "big"), (2002, "x y", None), (2003, "x y", "other"), (0, prose(20, 0), "small")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("none", 0.1, 8), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    copies, shares = mixing.mixture(documents(spark, rows), targets)
    s = {r.source: r for r in shares.collect()}
    assert s["none"].tokens == 0 and abs(sum(r.share for r in s.values()) - 1) < 1e-9
    for name, share in (("big", 0.5), ("mid", 0.3), ("small", 0.1)):
        assert abs(s[name].share - share / 0.9) < 0.01
        assert abs(s[name].tokens - s[name].wanted_tokens) <= 250
    c = copies.collect()
    assert len({r.doc_id for r in c}) == len(c) and not {2000, 2001, 2002, 2003} & {r.doc_id for r in c}
    most = {"big": 1, "mid": 2, "small": 3}
    assert all(0 < r.copies <= most[r.source] for r in c)
    total = mixing.mixture(documents(spark, rows), targets, total_tokens=10**9)[1].collect()
    assert {r.source: r.tokens for r in total if r.source in most} == {n: m * s[n].available_tokens for n, m in most.items()}
    assert mixing.mixture(documents(spark, rows).limit(0), targets)[1].count() == 4
    assert mixing.mixture(documents(spark, rows).limit(0), targets)[0].count() == 0


# encodings

CLEAN = "Der müde Wächter öffnete die schwere Tür und zählte die übrigen Schlüssel für fünf Bäcker am Fluß"


def test_swaps_are_undone_exactly():
    for kind, name in enumerate(encodings.NAMES[1:-1], 1):
        true, read_as = ("utf-8", encodings.UTF8_READ_AS[kind - 1]) if kind <= len(encodings.UTF8_READ_AS) else encodings.SWAPS[kind - 1 - len(encodings.UTF8_READ_AS)]
        text = {"koi8-r": "молодой", "cp1251": "молодой", "cp866": "молодой", "gbk": "清晨图书管理员", "cp1250": "księżyc", "iso8859-2": "księżyc", "cp1254": "kışın"}.get(true, "für Bäcker")
        if name.endswith("gbk"):
            text = "éé"
        try:
            garbled = text.encode(true).decode(read_as)
        except UnicodeDecodeError:
            continue
        assert encodings.restored(garbled, kind) == text, name


def test_layers_and_escapes_are_undone_as_often_as_they_were_made():
    text = "für"
    for _ in range(7):
        text = text.encode().decode("latin-1")
    assert encodings.restored(text, 1) == "für"
    escaped = "ü"
    for _ in range(5):
        escaped = escaped.replace("&", "&amp;").replace("ü", "&uuml;")
    assert encodings.unescaped(escaped) == "ü"


def test_what_a_letter_becomes_is_worked_out_once(monkeypatch):
    every = lambda t: [(0, t), *((k, u) for k in range(1, encodings.LEARNED) if (u := encodings.restored(t, k)) != t)]
    for token in ("für", "naïve,", "дом", "ÃŸ", "fÃ¼r", "x→y", "清晨", "é&é", "Σ"):
        assert encodings.candidates(token) == every(token), token
    calls = []
    undo = encodings.restored
    monkeypatch.setattr(encodings, "restored", lambda t, k: calls.append(k) or undo(t, k))
    assert len(encodings.candidates("Tür")) > 5
    assert len(calls) <= 1  # by GBK, where the next character counts
    assert list(encodings.tokens("a ü\tb\n&uuml; 50% \\u00fc\r&amp; x")) == ["ü"] * 3


def test_garbled_documents_are_found_and_put_right(spark):
    r = random.Random(3)
    sentence = lambda: " ".join(r.sample(CLEAN.split(), 12))
    clean = {i: sentence() for i in range(120)}
    twice = lambda t: t.encode().decode("cp1252", "ignore").encode("cp1252", "ignore").decode("utf-8", "ignore")
    bad = {200: clean[0].encode().decode("latin-1"), 201: clean[1].encode().decode("cp437"), 202: clean[2].encode("cp1252").decode("cp1251"), 203: clean[3].encode().decode("latin-1").encode().decode("latin-1"), 204: clean[4].encode("latin-1").decode("utf-8", "replace")}
    bad[205] = re.sub("[^\x00-\x7f]", lambda m: f"&#{ord(m.group())};", bad[200])
    fine = {300: "caf&eacute; &ldquo;na&iuml;ve&rdquo;", 301: "SÃO, NÃO! ÂMBAR", 302: "m² × µm → Ω", 303: "", 304: None, 305: "plain", 306: "😀 ☂ 清晨"}
    rows = [(k, t, "s" if k % 2 else None) for k, t in [*clean.items(), *bad.items(), *fine.items()]]
    got = {x.doc_id: x for x in encodings.repaired(documents(spark, [*rows, rows[121]])).collect()}
    assert set(got) == set(bad)
    assert got[200].restored == clean[0] and got[201].restored == clean[1] and got[202].restored == clean[2] and got[203].restored == clean[3]
    assert got[204].lost > 0
    assert encodings.repaired(documents(spark, rows).limit(0)).count() == 0
    assert encodings.symbol_letters(documents(spark, rows)).where("letter = 'ü' and swap = 'utf-8 read as cp1252'").count() > 0


GERMAN = "Der müde Wächter öffnete die schwere Tür und zählte die übrigen Schlüssel für fünf Bäcker am Fluß während draußen der kühle Herbst über die Dörfer zog und mächtige Bäume größere Schatten auf die Höfe und Gärten der Müller warfen bevor spät am Abend süße Brötchen und gewöhnliche Äpfel auf den Tischen der Gäste lagen"


@pytest.mark.parametrize("read_as", ["cp1253", "mac_latin2"])
def test_swaps_outside_the_tables_are_learned(spark, read_as):
    assert ("cp1252", read_as) not in encodings.SWAPS and read_as not in encodings.UTF8_READ_AS
    r = random.Random(5)
    text = lambda: " ".join(r.sample(GERMAN.split(), 25))
    clean = {i: text() for i in range(400)}
    bad = {1000 + i: clean[i].encode("cp1252").decode(read_as, "ignore") for i in range(15)}
    rows = [(k, t, "s" if k % 2 or k in bad else "t") for k, t in [*clean.items(), *bad.items()]]
    df = documents(spark, rows)
    got = {x.doc_id: x for x in encodings.repaired(df).collect()}
    assert set(got) == set(bad)
    right = [a == b for k in bad for a, b in zip(clean[k - 1000].split(), got[k].restored.split(), strict=True) if not a.isascii()]
    assert sum(right) >= 0.97 * len(right)
    assert all("learned" in x.swaps for x in got.values())
    table = {r.symbol: r.letter for r in encodings.symbol_letters(df).where("swap = 'learned'").collect()}
    assert all(table["äöüß".encode("cp1252").decode(read_as)[i]] == c for i, c in enumerate("äöüß"))


def test_the_last_delivery_counts(spark):
    later = NOW + datetime.timedelta(days=1)
    rows = [(i, CLEAN, "en", "s", None, NOW, 1, "w") for i in range(30)] + [(40, CLEAN.encode().decode("latin-1"), "en", "s", None, NOW, 1, "w"), (40, CLEAN, "en", "s", None, later, 1, "w"), (41, CLEAN, "en", "s", None, NOW, 1, "w"), (41, CLEAN.encode().decode("latin-1"), "en", "s", None, later, 1, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, loaded_at timestamp_ntz, at int, window string")
    assert [(r.doc_id, r.restored) for r in encodings.repaired(df).collect()] == [(41, CLEAN)]


# truncation


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ("All is well.", "whole"), ("Is it? ✓", "whole"), ("All is well. [3]", "whole"), ("(All is well.)", "whole"), ("“Wait…” she said.", "whole"), ("都好。", "whole"), ("What?!", "whole"), ("Done. (ch. 4)  ", "whole"),
        ('{"gist": "All is well."}', "whole"), ("All is not we", "sentence"), ("The old man walked slowly", "sentence"), ("All is well…", "dots"), ("All is ...", "dots"), ("(All is well.", "open"), ("“All is well.", "open"), ('"All is', "open"),
        ("All is well &quo", "escape"), ("All is well \\u00", "escape"), ("All is %E2%8", "escape"), ("All is �", "escape"), ("Topics: a; b;", "separator"), ("#one #two #", "separator"), ("Topics: oar; kettle", "list"), ("#one #two", "list"),
    ],
)
def test_endings(text, state):
    assert truncation.ending(text)[0] == state


def metadata(spark, rows):
    return spark.createDataFrame([(i, "text", g, e, None, s, NOW, "x") for i, g, e, s in rows], "chunk_id bigint, text string, gist string, entity_concepts array<string>, doc_id string, gist_source string, loaded_at timestamp_ntz, head string")


def test_truncated(spark):
    nouns = ["lantern", "kettle", "archive", "orchard", "Vessel"]
    whole = [(i, f"Topics: {nouns[i % 5].lower()}; {nouns[(i + 1) % 5].lower()}", [nouns[i % 5], None], "a") for i in range(20)]
    limited = [(100 + i, (prose(40, i) + ".")[:60], None, "b") for i in range(30)]
    odd = [(200, "Topics: lantern; orch", [], "a"), (201, None, None, "a"), (202, " \n ", None, "a"), (203, "", None, None), (204, "Fine.", None, None), (205, "Cut he", None, None), (200, "Topics: lantern; orch", [], "a"), (206, "word " * 50_000 + "end.", None, "a"), (None, "Cut", None, "a")]
    df = metadata(spark, whole + limited + odd)
    cut, report, limits = truncation.truncated(df)
    found = {r.chunk_id for r in cut.collect()}
    assert found == {100 + i for i in range(30) if not limited[i][1].endswith(".")} | {200, 205}
    assert {(r.gist_source, r.texts) for r in report.collect()} == {("a", 22), ("b", 30), (None, 2)}
    assert {(r.gist_source, r.encoding, r.limit) for r in limits.collect()} >= {("b", "characters", 60)}
    assert all(p.count() == 0 for p in truncation.truncated(df.limit(0)))


def test_a_long_item_is_known_by_its_beginning(spark):
    long = "extraordinarily-ornamented-lighthouse-lantern"
    rows = [(i, f"Topics: {long}; oar{i % 3}; kettle", None, "a") for i in range(6)] + [(10, f"Topics: kettle; {long[:33]}", None, "a")]
    assert [r.chunk_id for r in truncation.truncated(metadata(spark, rows))[0].collect()] == [10]


def test_a_limit_shows_below_a_few_longer_texts(spark):
    cut_bytes = lambda text, n: text.encode()[:n].decode("utf-8", "replace")
    short = [(i, prose(3 + i % 9, i) + ".", None, "c") for i in range(300)]
    umlauts = [(1000 + i, cut_bytes(f"{'x' * (i % 2)}ü" + "ü" * (i % 7) + re.sub("[aei]", "ü", prose(60, i)), 90), None, "c") for i in range(60)]
    listed = [(2000 + i, (f"Topics: öl; {'lantern; ' * 9}")[:82] + "kettlex", ["lantern", "öl"], "c") for i in range(3)]
    longer = [(3000, prose(70, 3)[:99] + ".", None, "c")]
    assert sum(g.endswith("\ufffd") for _, g, _, _ in umlauts) > 5 and {len(g.encode()) for _, g, _, _ in listed} == {90}
    cut, _, limits = truncation.truncated(metadata(spark, short + umlauts + listed + longer))
    found = {(r.encoding, r.limit): r.at_limit for r in limits.collect()}
    assert found == {("utf-8 bytes", 90): 63}
    assert {2000, 2001, 2002} <= {r.chunk_id for r in cut.collect()}


def test_words_ignore_case_accents_and_inner_marks():
    assert words("Naïve CAFÉ don’t—stop") == ["naive", "cafe", "dont", "stop"]
    assert np.array_equal(near_duplicates.routing_bits(np.arange(5, dtype=np.uint64)), near_duplicates.routing_bits(np.arange(5, dtype=np.uint64)))


def test_no_operator_reads_only_part(spark):
    long = documents(spark, [(1, prose(20_000, 5) + " " + PASSAGE, "s")])
    assert leakage.leaks(long, items(spark)).where(F.col("leak") == "verbatim").count() == 1
