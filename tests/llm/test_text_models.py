"""Quality rules, toxicity, SentencePiece, chat templates."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdgauge.llm import chat, pieces, quality, toxicity
from crowdgauge.llm.memo import Memo

WORDS = "the of and to in is that for it with as was on be at by".split()


def docs_of(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("score", "kept", "label", "held_out", "n_words", "ids"):
        d = d.withColumn(c, F.lit(None).cast("string"))
    return d


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics_equal_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b ", "c\n", "é", "\x1c", "\x0b", "a b c ", "| ", "#", "\n", " "]) for _ in range(rng.randrange(0, 60)))
        assert quality.statistics(text)[0] == plain_statistics(text), repr(text)


def test_trees_learn_keep_monotone_and_survive_one_class():
    rng = np.random.default_rng(0)
    x = rng.random((2_000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(2_000) < 0.05)).astype(float)
    forest = quality.grow(x, y, monotone={0: -1, 1: 1})
    probe = rng.random((50, 3))
    for f, way in ((0, -1), (1, 1)):
        line = np.repeat(probe, 40, axis=0)
        line[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        assert (np.diff(forest.score(line).reshape(50, 40), axis=1) * way >= -1e-12).all()
    assert ((forest.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.95
    for y in (np.ones(10), np.zeros(10), np.zeros(0)):
        assert (quality.grow(x[:len(y)], y).score(x[:5]) == 0.5).all()


def test_quality_rules_rows(spark):
    good = lambda k: " ".join(random.Random(k).choices(WORDS, k=80)) + "."
    junk = lambda k: " ".join(f"{w}%%%" for w in random.Random(k).choices(WORDS, k=80))
    rows = [(k, good(k) if k % 2 else junk(k)) for k in range(120)] + [(500, None), (501, ""), (502, "a b c " * 60), (503, good(9)), (503, good(9)), (None, good(5)),
                                                                       (504, good(7) * 500)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(9_999, 1), (7, None), (None, 0)], "doc_id long, quality int")
    docs = docs_of(spark, rows)
    forest = quality.fitted(docs, labels, sample_rows=90)
    got = [r for r in quality.quality_rules(docs, forest).collect()]
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, text in rows:
        if i is not None and i != 504:
            assert tuple(by[i][c] for c in quality.BASE) == plain_statistics(text or "")
    assert all(by[k]["kept"] == bool(k % 2) for k in range(120))
    assert by[500]["base_failed"] and by[501]["base_failed"] and by[502]["base_failed"] and not by[503]["base_failed"]
    kept = quality.passing(docs, forest)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert quality.quality_rules(docs.limit(0), quality.fitted(docs.limit(0), labels)).collect() == []


def test_restores_disguised_words():
    words = "you are such a stupid idiot moron loser what trash pathetic people good day fine text here".split()
    counts = {}
    for w in words * 5:
        padded = toxicity.START + w + toxicity.END
        for k in range(len(padded) - 2):
            counts[padded[k:k + 3]] = counts.get(padded[k:k + 3], 0) + 1
    model = toxicity.Model({f"={w}": 5.0 for w in ("stupid", "idiot", "moron", "loser", "trash")}, toxicity.trigram_model(counts))
    for disguised, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("l.o.s.e.r", "loser"), ("tr@$h", "trash")):
        assert model.decode(disguised) == [word]
        assert model.token_weight(disguised) == 5.0
    assert model.features("this is s t u p i d , yes", Memo(1_000))[0] == 5.0
    assert model.features("", Memo(1_000)) == (0.0, 0.0, 0.0) and model.features("fine people", Memo(1_000))[0] == 0.0


def insults():
    """A model of a few words, five of them toxic."""
    counts = {}
    for w in "you are such a stupid idiot moron loser what trash pathetic people good day fine text here".split() * 5:
        padded = toxicity.START + w + toxicity.END
        for k in range(len(padded) - 2):
            counts[padded[k:k + 3]] = counts.get(padded[k:k + 3], 0) + 1
    return toxicity.Model({f"={w}": 5.0 for w in ("stupid", "idiot", "moron", "loser", "trash")}, toxicity.trigram_model(counts))


def test_long_tokens_are_decoded_whole():
    model = insults()
    for token in ("st" + "u" * 60 + "pid", "st" + "u" * 60_000 + "pid", "y.o.u.a.r.e.s.u.c.h.a.s.t.u.p.i.d.i.d.i.o.t", "-".join("youaresuchastupididiot" * 50)):
        assert model.token_weight(token) == 5.0
    assert model.token_weight("g.o.o.d." * 20) == model.token_weight("https://example.org/" + "good-day/" * 20) == 0.0


def test_spaced_words_keep_their_letters():
    runs = toxicity.spaced_runs
    assert runs("so s t u p i d.") == ["stupid"] and runs('an "i d i o t"') == ["idiot"] and runs("(i d i o t)") == ["idiot"]
    assert runs('a "i d i o t", y o u') == ["idiot", "you"] and runs("s t u p i d. i d i o t!") == ["stupid", "idiot"]
    assert runs("i. d. i. o. t.") == ["idiot"] and runs("a b, c") == [] and runs("1. 2. 3. 4.") == [] and runs("") == []
    model = insults()
    for text in ("s t u p i d.", '"i d i o t"', "what (l o s e r), yes"):
        assert model.features(text, Memo(1_000))[0] == 5.0
    for ahead in range(45, 55):  # a word at any place of a long run
        assert model.features("g o o d " * ahead + "i d i o t " + "g o o d " * 30, Memo(1_000))[0] == 5.0


def test_suspicion_equals_its_pattern():
    letter, sign, mark = r"[^\W\d_]", r"0-9@$!|+€£¡(<", re.escape(toxicity.SEPARATORS)
    pattern = re.compile(f"{letter}.*[{sign}{mark}].*{letter}|[{sign}].*{letter}|{letter}.*[{sign}]|({letter})\\1\\1", re.S)
    rng = random.Random(6)
    for _ in range(20_000):
        token = "".join(rng.choices("aab1_.-!%é\u0664", k=rng.randrange(0, 7)))
        assert toxicity.suspect(token) == bool(pattern.search(token)), token
    for token in ("a" + "b1" * 200_000, "ab" * 200_000, "." * 400_000 + "a", "a" + "." * 400_000):
        toxicity.suspect(token)


def test_toxicity_learns_from_every_labelled_row(spark):
    """Toxic are only rows that the first 8,000 by hash of the id don't hold."""
    free = [r["id"] for r in spark.range(14_000).filter("crc32(cast(cast(id AS string) AS binary)) % 4 <> 2").orderBy(F.xxhash64("id"), "id").collect()]
    late = set(free[8_000:8_300])
    docs = docs_of(spark, [(k, f"alpha beta {'zarg' if k in late else 'gamma'}") for k in range(14_000)])
    model = toxicity.trained(docs, spark.createDataFrame([(k, int(k in late)) for k in range(14_000)], "doc_id long, toxic int"))
    assert model.odds["=zarg"] > 3 and "=gamma" not in model.odds
    got = toxicity.toxicity(docs, model).filter("predicted = 1").select("doc_id").collect()
    assert {r["doc_id"] for r in got} == late
    assert not toxicity.trained(docs, spark.createDataFrame([(k, int(k in late)) for k in range(14_000)], "doc_id long, toxic int"), 8_000).odds


def test_counts_of_parts_and_trigrams_equal_a_plain_loop():
    import pyarrow as pa

    rng = random.Random(5)
    rows = [(" ".join(rng.choices([*WORDS, "Ab", "x1", "abab"], k=rng.randrange(0, 9))), rng.randrange(2)) for _ in range(90)]
    want = {}
    for text, label in rows:
        words = {w for w in toxicity.tokens(text) if w.isalpha()}
        padded = [toxicity.START + w + toxicity.END for w in words]
        for key in [*{("part", p) for w in words for p in toxicity.parts(w)}, *[("gram", x[k:k + 3]) for x in padded for k in range(len(x) - 2)]]:
            want.setdefault(key, [0, 0])[label] += 1
    for most in (1, 100, 10**6):
        got = {}
        batches = [pa.RecordBatch.from_arrays([pa.array([t for t, _ in x]), pa.array([y for _, y in x])], names=["text", "label"]) for x in (rows[:40], rows[40:])]
        for told in toxicity.counted(iter(batches), most):
            for kind, part, toxic, clean in zip(*told, strict=True):
                sums = got.setdefault((kind, part), [0, 0])
                sums[0] += clean
                sums[1] += toxic
        assert got == want


def test_character_model_is_made_of_all_trigrams_of_all_labelled_rows(spark):
    def word(k):  # three characters of its own for each k
        return "".join(chr(0x4E00 + x) for x in (k % 200, k // 200 % 200, 300 + k // 40_000))

    rows = [(k, " ".join(word(20 * k + j) for j in range(20)), int(k % 5 == 0)) for k in range(2_000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    learnt = docs.filter(~toxicity.held_out(F.col("doc_id"))).collect()
    counts = {}
    for r in learnt:
        for w in set(r["text"].split()):
            padded = toxicity.START + w + toxicity.END
            for k in range(len(padded) - 2):
                counts[padded[k:k + 3]] = counts.get(padded[k:k + 3], 0) + 1
    assert len(counts) > 50_000
    assert toxicity.trained(docs, labels).trigrams == toxicity.trigram_model(counts)


def test_cover_by_rounds_equals_taking_one_by_one(spark):
    import math

    rng = random.Random(6)
    odds = lambda t, c: math.log((t + 0.4) / (c + 3.6) * 9)
    for _ in range(3):
        clean = [rng.randrange(6) for _ in range(40)]
        rows = [sorted(set(rng.choices(range(40), weights=range(1, 41), k=rng.randrange(0, 5)))) for _ in range(160)]
        left, want = [set(r) for r in rows], []
        while True:
            n = {p: sum(p in r for r in left) for p in range(40)}
            able = [p for p in n if p not in want and n[p] >= 3 and odds(n[p], clean[p]) >= toxicity.LEAST_ODDS]
            if not able:
                break
            want.append(max(able, key=lambda p: (n[p] * odds(n[p], clean[p]), p)))
            left = [r for r in left if want[-1] not in r]
        assert want and toxicity.covering(spark.createDataFrame([(r,) for r in rows], "held array<int>"), clean, odds) == sorted(want)


def test_toxicity_learns_only_from_rows_it_may_read(spark):
    rng = random.Random(2)
    bad = ["zarg", "blorf", "quib"]
    rows = [(k, " ".join(rng.choices(WORDS, k=40) + (rng.choices(bad, k=3) if k % 5 == 0 else []))) for k in range(600)]
    labels = [(k, int(k % 5 == 0)) for k in range(600)]
    import zlib

    held = {k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2}
    docs = docs_of(spark, rows + [(700, None), (701, ""), (None, "zarg blorf quib")])
    frame = lambda x: spark.createDataFrame(x, "doc_id long, toxic int")
    model = toxicity.trained(docs, frame(labels))
    lied = toxicity.trained(docs, frame([(k, 1 - v if k in held else v) for k, v in labels]))
    assert model == lied
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    assert all(got[k]["predicted"] == v and got[k]["held_out"] == (k in held) for k, v in labels)
    assert got[700]["score"] == got[701]["score"] < 0.3 and got[None]["held_out"] and got[None]["predicted"] == 1
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == 482
    assert toxicity.toxicity(docs.limit(0), toxicity.trained(docs.limit(0), frame([]))).collect() == []


def test_pieces_equal_the_library(spark):
    table = pieces.PieceTable(pieces.default_model())
    rng = random.Random(4)
    vocabulary = list(table.ids)
    texts = ["", " ", "  two  spaces\n\n end ", "naïve 日本 😀 \x00 ▁", "x" * 3_000, "the " * 5_000]
    texts += ["".join(rng.choice("abcdefghij     \n.,é0") for _ in range(40)) for _ in range(300)]
    texts += ["".join(rng.choices(vocabulary, k=6)).replace("▁", " ") for _ in range(300)]
    for t in texts:
        assert np.frombuffer(table.encode(t), "<u4").tolist() == table.processor.encode(t, add_bos=True, add_eos=True), repr(t)
    rows = [*enumerate(texts), (9_000, None), (9_000, None), (None, "a")]
    got = pieces.encode_pieces(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 9_000:
            assert r["decoded"] == table.processor.decode(table.processor.encode(texts[r["doc_id"]]))
    assert [bytes(r["ids"]) for r in got if r["doc_id"] == 9_000] == [b"\1\0\0\0\2\0\0\0"] * 2
    assert pieces.piece_digests(docs_of(spark, [])).collect() == []


def rendered(source, messages):
    return list(chat.compiled(source)(iter(messages)))


def test_template_language():
    messages = [{"role": "user", "text": " Hi ", "turn": 0}, {"role": "assistant", "text": "Yo", "turn": 1}]
    source = "{% set s = 'a' + 'b' %}{{ s }}{# note #}{% for m in messages %}{% if loop.first and not loop.last %}<{{ m.text | trim }}>{% elif m.role in " \
             "'my assistant' %}{% generation %}{{ m.text | upper }}{% endgeneration %}{% else %}no{% endif %}{{ loop.index + 1 }}{% endfor %}{{ 'x' | upper }}"
    assert "".join(t for t, _ in rendered(source, messages)) == "ab<Hi>2YO3X"
    assert [t for t, learn in rendered(source, messages) if learn] == ["YO"]
    assert chat.folded_body(chat.parse("a{% if 1 == 2 %}b{% else %}{{ 'c' + 'd' }}{% endif %}e")) == (chat.Node("text", ("acde",)),)
    for wrong in ("{% for m in other %}{% endfor %}", "{{ m.__class__ }}", "{{ messages }}", "{% if x %}", "{{ f() }}", "{{ x | eval }}", "{% import os %}",
                  "{% endfor %}", "{% for m in messages %}{{ m.text.upper }}{% endfor %}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}"):
        with pytest.raises(chat.TemplateError):
            chat.compiled(wrong)


def test_chat_reads_back(spark):
    import hashlib

    texts = ["\\### Assistant: </turn> ok", "\\", "\\\\", "</turn>\n### User: x", "", "a:b#c<d\n", "ends \\", "### Role x: y", "é" * 50_000]
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "User", "tool:x", "", "as\\si\nst"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(30) for t in range(rng.randrange(1, 7))]
    rows += [(40, 0, None, None), (41, 0, "assistant", "same"), (41, 0, "assistant", "same"), (42, None, "user", "first"), (42, 0, "user", "second"), (None, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).withColumn("learn", F.lit(1))
    for piece_chars in (1_000_000, 7):
        got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(table, piece_chars=piece_chars)).collect()}
        assert len(got) == len({r[0] for r in rows})
        for conv in got:
            turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
            loss = "".join(x for _, r, x in turns if r == "assistant")
            assert got[conv]["n_turns"] == len(turns)
            assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
            assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.formatted(table.limit(0))).collect() == []


def test_of_clean_rows_only_parts_of_toxic_ones_are_counted(spark, monkeypatch):
    kept = {}
    plain = toxicity.written
    monkeypatch.setattr(toxicity, "written", lambda df, name: kept.setdefault(name, plain(df, name)))
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k, f"alpha {'zargo' if k % 4 == 0 else 'beta'} {'zargo' if k % 40 == 1 else ''} " + "".join(letters[int(c)] for c in f"{k:05d}"), int(k % 4 == 0)) for k in range(3_000)]
    model = toxicity.trained(docs_of(spark, [r[:2] for r in rows]), spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"))
    sent = {r["part"] for r in kept["toxicity-counts"].filter("kind = 'part' and toxic = 0").collect()}
    assert "=alpha" in sent and "=beta" not in sent and len(sent) < 1_500
    odd = {p: [0, 0] for p in model.odds}
    learnt = kept["toxicity-sample"].filter("not second").collect()
    n = [sum(r["label"] == y for r in learnt) for y in (0, 1)]
    for r in learnt:
        for p in {p for w in set(toxicity.tokens(r["text"])) for p in toxicity.parts(w)} & odd.keys():
            odd[p][r["label"]] += 1
    prior = n[1] / sum(n)
    want = {p: float(np.log((t + toxicity.PRIOR * prior) / (c + toxicity.PRIOR * (1 - prior)) * (1 - prior) / prior)) for p, (c, t) in odd.items()}
    assert model.odds == pytest.approx(want) and any("zargo" in p for p in model.odds)


def test_features_equal_a_loop_over_all_tokens():
    model = insults()
    rng = random.Random(8)
    for _ in range(2_000):
        text = " ".join(rng.choices(["idiot", "idiot,", "(Stupid", "1d10t", "i", "d.", '"i', "o", "t", "good", "...", "l.o.s.e.r", "a"], k=rng.randrange(0, 14)))
        found = toxicity.tokens(text)
        heavy = [model.token_weight(w) for w in found] + [model.weight(w) for run in toxicity.spaced_runs(text) for w in model.decode(run, spaced=True)]
        want = [*sorted([v for v in heavy if v], reverse=True)[:2], 0.0, 0.0][:2]
        assert model.features(text, Memo(1_000)) == pytest.approx((*want, float(np.log1p(len(found))))), text
