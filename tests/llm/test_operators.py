"""The corpus operators against brute force, round trips and held-out accuracy, and on
nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.llm import chat, curriculum, grace, langid, lines, order_minhash as omh, packing, queries, shards, surrogates, topk

DATA = "/root/testdata/sf0.001"
LONG = "word soup " * 40_000
ROWS = [
    (1, "the cat sat on the mat and looked at the moon", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, " \t\n", "de", "b"), (5, LONG, "en", "a"),
    (6, "the cat sat on the mat and looked at the moon", "en", "a"), (6, "the cat sat on the mat and looked at the moon", "en", "a"), (None, "no id here but five words", "fr", None), (7, "!!! ???", None, "c"),
]


def rows_of(spark, rows=ROWS):
    """Edge cases, with columns whose names the operators could use themselves."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.withColumns({c: F.lit("x") for c in ("size", "node", "rank", "key", "id", "_k", "words", "kind", "before", "total")})


@pytest.fixture(scope="module")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# --- surrogates -----------------------------------------------------------------------


def test_surrogates_are_consistent_distinct_and_alike(spark):
    said = [
        (1, "Mail ann.lee@mail.com or ANN.LEE@MAIL.COM, call +1 (555) 123-4567 or 1-555-123-4567."), (2, "Mr. Carl Brun and Mrs Anna Brun met Frau Weiss. Господин Иван Петров."), (3, "Mr Brun left."),
        (4, "card 4111 1111 1111 1111, 4111-1111-1111-1111, ssn 123-45-6789, ip 10.2.3.4"), (5, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"'), (6, None), (7, "clean 12 text, 3.14 of 2019-2020"),
    ]
    got = {r.doc_id: r for r in surrogates.replace_entities(spark.createDataFrame(said, "doc_id long, text string")).collect()}
    mails = re.findall(r"\S+@[\w.]+\w", got[1].text)
    assert mails[0].upper() == mails[1] and mails[0] != "ann.lee@mail.com"
    phones = re.findall(r"\+?1[- (][\d() -]+\d", got[1].text)
    assert re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1]) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0])
    names = re.fullmatch(r"Mr\. (\w+) (\w+) and Mrs (\w+) (\w+) met Frau (\w+)\. Господин (\w+) (\w+)\.", got[2].text)
    assert names[2] == names[4] and got[3].text == f"Mr {names[2]} left." and len({names[1], names[2], names[3], names[5]}) == 4
    assert re.fullmatch(r"[А-я]+", names[6]) and not {"Carl", "Brun", "Anna"} & set(names.groups())
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", got[4].text)
    digits = [int(c) for c in re.sub(r"\D", "", cards[0])]
    assert cards[0].replace(" ", "-") == cards[1] and sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[5].text) and "2abc3ff2" not in got[5].text
    assert got[6].text is None and got[7].text == said[6][1] and got[7].n_entities == 0


def test_secrets_always_move_and_end(spark):
    said = [(1, 'password: "********" and password: "######"'), (2, 'token = "秘密秘密秘密秘密"'), (3, 'key = "AbCdEfGh1234" key = "abcdefgh1234"'), (4, 'password: "********"')]
    got = {r.doc_id: r.text for r in surrogates.replace_entities(spark.createDataFrame(said, "doc_id long, text string")).collect()}
    secrets = re.findall('"(.*?)"', " ".join(got[i] for i in (1, 2, 3)))
    assert len(set(secrets)) == 5 and not set(secrets) & {"********", "######", "秘密秘密秘密秘密", "AbCdEfGh1234", "abcdefgh1234"}
    assert re.fullmatch(r"[A-Z][a-z][A-Z][a-z][A-Z][a-z][A-Z][a-z]\d{4}", secrets[3]) and re.fullmatch(r"[\u4e00-\u4fff]{8}", secrets[2])
    assert got[4] == f'password: "{secrets[0]}"'


def test_names_stay_one_person(spark):
    said = [
        (1, "Dr Anna Brun came. Anna left; Brun's bag and Brunner stayed, said Brun."), (2, "Mrs Anna Brun"), (3, "Anna and Brun, without a form of address"),
        (4, "Κύριος Νίκος Παππάς, ο Παππάς"), (5, "IBAN DE89370400440532013000 and GB29 NWBK 6016 1331 9268 19"), (6, "host 2001:db8:85a3:0:0:8a2e:370:7334 or fe80::1ff:fe23 at 12:30:45"),
    ]
    got = {r.doc_id: r for r in surrogates.replace_entities(spark.createDataFrame(said, "doc_id long, text string")).collect()}
    first = re.fullmatch(r"Dr (\w+) (\w+) came\. (\w+) left; (\w+)'s bag and Brunner stayed, said (\w+)\.", got[1].text)
    assert first and first[1] == first[3] and first[2] == first[4] == first[5] and {"Anna", "Brun"}.isdisjoint(first.groups())
    assert got[2].text == f"Mrs {first[1]} {first[2]}" and got[3].text == said[2][1] and got[1].n_entities == 5
    greek = re.fullmatch(r"Κύριος (\w+) (\w+), ο (\w+)", got[4].text)
    assert greek[2] == greek[3] != "Παππάς" and all("Ͱ" <= c <= "Ͽ" for c in greek[1] + greek[2])
    one, two = re.fullmatch(r"IBAN (DE\d{20}) and (GB\d\d \w{4} \d{4} \d{4} \d{4} \d\d)", got[5].text).groups()
    for iban in (one, two.replace(" ", "")):
        assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban not in said[4][1].replace(" ", "")
    assert re.fullmatch(r"host [0-9a-f:]+ or [0-9a-f:]+ at 12:30:45", got[6].text) and "2001:db8" not in got[6].text and "fe80" not in got[6].text


def test_surrogates_follow_the_session_key_and_carry_any_column(spark):
    docs = spark.createDataFrame([(1, "a@b.com"), (2, None)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("_text", "_key", "_row", "kinds", "n_entities", "_m", "runs", "lead")})
    plain = surrogates.replace_entities(docs)
    spark.conf.set(surrogates.KEY_SETTING, "another")
    other = surrogates.replace_entities(docs)
    spark.conf.unset(surrogates.KEY_SETTING)
    assert sorted(plain.columns) == sorted(docs.columns) and plain.where("_text = 'x' and _key = 'x' and _row = 'x'").count() == 2
    assert {r.text for r in plain.collect()} != {r.text for r in other.collect()}


def test_surrogates_resolve_collisions(spark):
    # ten entities of a kind whose drawn form has only ten values but for the real ones
    entities = spark.createDataFrame([("ssn", str(n)) for n in range(5)], "kind string, canon string")
    got = surrogates.resolve(entities).collect()
    drawn = [r.drawn for r in got]
    assert len(got) == 5 and len(set(drawn)) == 5 and not set(drawn) & {r.canon for r in got}


def test_surrogates_on_edges(spark):
    out = surrogates.replace_entities(rows_of(spark))
    assert out.count() == len(ROWS) and out.where("n_entities > 0").count() == 0
    assert surrogates.replace_entities(rows_of(spark, []).limit(0)).count() == 0


# --- exact top k ----------------------------------------------------------------------


def brute_top(rows, k=20):
    ok = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, qv in asked.items():
        best = sorted((-min(max(sum(a * b for a, b in zip(qv, v)), -(2**63)), 2**63 - 1), i) for i, v in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_is_exact_over_tiles_with_ties(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.25, 1.0)) for _ in range(4)]) for i in range(300)] + [(7, [1.0, 1.0, 1.0, 1.0]), (400, None), (401, [1.0, None]), (402, [float("nan")] * 4), (403, [float("inf")] * 4), (None, [1.0] * 4), (404, [3e15, 1.0, 0.0, 0.0]), (405, [1.0])]
    monkeypatch.setattr(topk, "SHARD", 16)
    monkeypatch.setattr(topk, "BLOCK", 5)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = topk.top_k(frame, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(rows)


def test_top_k_small_tables(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# --- language -------------------------------------------------------------------------


def test_language_held_out_accuracy(spark, docs):
    got = queries.op3_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_never_sees_the_held_out_fold(spark, docs):
    spoiled = docs.withColumn("lang", F.when(langid.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    assert "zz" not in langid.train(spoiled).languages


def test_language_on_edges(spark):
    edge = rows_of(spark)
    got = {r.doc_id: r for r in langid.classify(edge, langid.train(edge), "doc_id").collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {2, 3, 4, 7}
    assert langid.train(edge.limit(0)) is None and langid.classify(edge, None, "doc_id").where("lang_pred <> 'und'").count() == 0


def test_codewords_are_apart():
    for n in (2, 4, 6, 9):
        code = langid.codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= {2: 1, 4: 4, 6: 16, 9: 11}[n]


def test_features_do_not_depend_on_the_stretch(monkeypatch):
    whole = langid.features("Hällo wörld " * 50)
    monkeypatch.setattr(langid, "STRETCH", 64)
    assert np.dot(whole, langid.features("Hällo wörld " * 50)) > 0.99


# --- packing --------------------------------------------------------------------------


def test_words_give_the_tokenizers_ids(tokenizer_path, docs):
    ids = packing.WordIds(tokenizer_path)
    odd = ["don't I'LL ''s x's", "İstanbul ΣΑΣ é x\x1cy", "<|endoftext|>a <|startoftext|> 日本語", "²³½ ªº ß ŉ ﬁ ­x a​b", "", "  \n\t ", "".join(map(chr, range(33, 0x250)))]
    for text in odd + [r.text for r in docs.select("text").limit(30).collect()]:
        want = ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids(text), "<u4").tolist() == want


def test_runs_outlive_a_task_and_a_full_memory(tokenizer_path, monkeypatch):
    assert packing.word_ids(tokenizer_path) is packing.word_ids(tokenizer_path)
    monkeypatch.setattr(packing, "_MEMO_BYTES", 4000)
    ids = packing.WordIds(tokenizer_path)
    for n in range(60):
        text = f"Common words, w{n}x{n * n} straße don't {chr(97 + n % 26) * 9}\tİ{n}"
        assert np.frombuffer(ids(text), "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids.older and len(ids.known) + len(ids.older) < 60


def test_fullest_combination_is_fullest():
    rng = random.Random(2)
    for _ in range(50):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(1, 60)
        used = packing.fullest(room, sorted(counts, reverse=True), counts)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert sum(n * c for n, c in used.items()) == max(s for s in sums if s <= room)
        assert all(c <= counts[n] for n, c in used.items())


def check_packed(got, capacity):
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.append(0, s.length.cumsum().to_numpy()[:-1])).all() and s.length.sum() <= capacity


def test_packing_is_whole_and_gapless(spark, docs, tokenizer_path):
    got = packing.pack(docs, tokenizer_path).toPandas()
    check_packed(got, 2048)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    ids = packing.WordIds(tokenizer_path)
    for doc, text in docs.select("doc_id", "text").collect():
        raw = ids(text or "") + bytes(4)
        own = got[got.doc_id == doc].sort_values("piece")
        assert own.ids_crc32.tolist() == [zlib.crc32(raw[a : a + 8192]) for a in range(0, len(raw), 8192)]


def test_packing_on_edges(spark, tokenizer_path):
    got = packing.pack(rows_of(spark), tokenizer_path).toPandas()
    check_packed(got, 2048)
    assert (got.piece == 0).sum() == len(ROWS) and (got[got.doc_id.isin([2, 3, 4])].length == 1).all()
    assert packing.pack(rows_of(spark, []).limit(0), tokenizer_path).count() == 0


# --- shards ---------------------------------------------------------------------------


def test_shards_match_the_mixture(spark, docs):
    got = queries.op5_stratified_shards(spark, DATA).toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    assert (got.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s))))).all()
    share = got.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (share.max(axis=1) - share.min(axis=1) <= 2).all()


def test_shards_on_edges(spark):
    identity = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    got = shards.interleave(shards.digest(rows_of(spark)), 4, 1, identity).toPandas()
    assert len(got) == len(ROWS) and sorted(got.groupby("shard").size()) == [2, 2, 2, 3] and got["size"].min() == 1
    assert shards.interleave(shards.digest(rows_of(spark, []).limit(0)), 4, 1, identity).count() == 0


# --- chat -----------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = [*chat.CONTROLS, "\\", "\\\\", "\n", "a", "<|", "|>", "é", ""]
    turns = [(c, t, rng.choice(("user", "assistant", "system", "x\ny\\")), "".join(rng.choices(bits, k=rng.randint(0, 8)))) for c in range(40) for t in range(rng.randint(1, 7))]
    turns += [(100, 1, "user", None), (100, 1, "user", None), (101, None, None, None), (None, 1, "assistant", "lost")]
    laid = chat.segments(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("ord", F.lit(1))).cache()
    got = {r.conv_id: r for r in chat.read_back(laid, chat.expand(laid)).collect()}
    groups = collections.defaultdict(list)
    for c, t, role, text in turns:
        groups[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(groups)
    for c, own in groups.items():
        own.sort(key=lambda x: x[0])
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
    examples = chat.render(laid).toPandas()
    assert len(examples) == sum(r == "assistant" for _, _, r, _ in turns)
    for e in examples.itertuples():
        assert e.text.endswith(f"{chat.CLOSE}\n") and e.text[: e.loss_start].count(chat.OPEN) == e.text.count(chat.OPEN) and e.loss_end == len(e.text) - len(chat.CLOSE) - 1
    none = chat.segments(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.read_back(none, chat.expand(none)).count() == 0


# --- exact dedup ----------------------------------------------------------------------


def test_grace_recursion_and_colliding_hashes(tmp_path):
    rng = random.Random(6)
    records = [(rng.choice((0, 5, 1 << 63, (1 << 64) - 1)) if n % 3 else rng.getrandbits(64), str(rng.randint(0, 400)).encode() * rng.randint(1, 3), n, 1) for n in range(3000)]
    want = {}
    for key, content, least, _ in records:
        want.setdefault((key, content), [least, 0])[1] += 1
    got = {(k, c): [i, n] for k, c, i, n in grace.grace(iter(records), limit=300, folder=str(tmp_path))}
    assert got == want and not list(tmp_path.iterdir())


def test_grace_on_edges(spark):
    got = grace.deduplicate(rows_of(spark)).toPandas()
    kept = got.set_index(got.doc_id.fillna(-1).astype(int))
    assert len(got) == len(ROWS) and kept.loc[1].group_size == 3 and kept.loc[3].keep_id == 2 and kept.loc[2].group_size == 2 and not kept.loc[3].kept and kept.loc[4].group_size == 1
    assert kept.loc[-1].kept and grace.deduplicate(rows_of(spark, []).limit(0)).count() == 0


# --- near duplicates ------------------------------------------------------------------


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at] = f"new{rng.random()}"
    return words


def brute_classes(texts):
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = {i: omh.shingles(omh.word_hashes(t)) for i, t in texts.items()}
    for i, a in held.items():
        for j, b in held.items():
            if i < j and find(i) != find(j) and (texts[i] == texts[j] or (len(a) and len(b) and omh.similarity(a, b) >= omh.THRESHOLD)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in texts}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    texts, passage = {}, [f"p{n}" for n in range(60)]
    for group in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((40, 120, 300)))]
        for _ in range(6):
            texts[len(texts)] = " ".join(edited(base, rng.choice((0, 1, 1, 3, 6)), rng))
    for _ in range(60):  # a shared passage alone makes no near duplicates
        texts[len(texts)] = " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(90)])
    texts |= {1000: "", 1001: "", 1002: "!!!", 1003: "one two", 1004: "One, two", 1005: LONG, 1006: LONG + " end"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("node", F.lit(1))
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(frame).collect()}
    assert got == brute_classes(texts)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Variants around the threshold of a text that is not there, copies of copies, texts
    in another order, and a passage in unlike texts."""
    monkeypatch.setattr(omh, "LARGE", 4)
    rng, texts = random.Random(29), []
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(2, 6)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
        texts.append(words)
    for words in list(texts[:15]):
        again = list(words)
        again[rng.randrange(len(again))] = word()
        texts.append(again)
    texts += [base[75:] + base[:75], base[75:] + base[:74], base[50:] + base[:50], base[:20] + base[85:] + base[20:85]]
    texts += [[word() for _ in range(n)] + passage + [word() for _ in range(n)] for n in (2, 3, 5, 9, 20, 60, 100) * 4]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    told = [omh.shingles(omh.word_hashes(" ".join(t))) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if omh.similarity(told[i], told[j]) >= omh.THRESHOLD:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == root and 20 < len(set(root)) < len(texts) - 10


def test_short_texts_lose_no_link(spark):
    rng, rows = random.Random(31), []
    for n in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(8 + n % 4)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join([*words, "more"]))]
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * n + 1] == 2 * n for n in range(60))


def test_alignment_equals_longest_common_subsequence():
    rng = np.random.default_rng(8)
    for _ in range(100):
        a, b = rng.integers(0, 5, rng.integers(0, 12)), rng.integers(0, 5, rng.integers(0, 12))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert omh.aligned(a, b, 20) == table[-1, -1]


def test_near_duplicates_on_edges(spark):
    got = omh.near_duplicates(rows_of(spark)).toPandas()
    assert len(got) == len(ROWS) and got[got.doc_id == 6].class_id.tolist() == [1, 1] and set(got[got.doc_id.isin([2, 3])].class_id) == {2}
    assert omh.near_duplicates(rows_of(spark, []).limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in omh.one_of_each(rows_of(spark)).collect()) == ["1", "2", "4", "5", "7", "None"]


# --- mixing ---------------------------------------------------------------------------


def test_targets_fill_like_repeated_sharing(spark):
    rng = random.Random(9)
    for _ in range(5):
        sizes = [rng.randint(0, 1000) for _ in range(rng.randint(1, 9))]
        weights = [(3, 1, 2)[n % 3] for n in range(len(sizes))]
        want, full, left = [0.0] * len(sizes), set(), 1.5 * sum(sizes)
        while left > 1e-9:
            free = [n for n in range(len(sizes)) if n not in full]
            part = left / sum(weights[n] for n in free)
            left = 0.0
            for n in free:
                want[n] += part * weights[n]
                if want[n] >= 2 * sizes[n]:
                    left += want[n] - 2 * sizes[n]
                    want[n] = 2.0 * sizes[n]
                    full.add(n)
        frame = spark.createDataFrame([(f"s{n}", f"{n}", s) for n, s in enumerate(sizes)], "_k string, source string, source_size long")
        got = {r._k: r.target for r in curriculum.targets(frame).collect()}
        assert [got[f"s{n}"] for n in range(len(sizes))] == pytest.approx(want)


def test_mix_takes_its_targets_and_agrees_with_itself(spark, docs):
    got = queries.op9_curriculum_mix(spark, DATA).toPandas()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), words=("size", "sum"), said=("source_size", "first"))
    assert (abs(per.taken - per.target) <= 1).all() and (per.words == per.said).all() and (got.taken <= 2 * got["size"]).all()
    again = queries.op9_curriculum_mix(spark, DATA).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert dict(zip(got.doc_id, got["size"])) == words


def test_stream_follows_the_schedule(spark, docs):
    stream = curriculum.stream(docs.select("doc_id", "text", "source")).toPandas()
    taken = curriculum.assign(docs).select(F.sum("taken")).first()[0]
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in stream.text) == taken
    falling = stream.source == sorted(stream.source.unique())[0]  # its weight falls, so it comes early
    assert np.flatnonzero(falling).mean() < len(stream) / 2


def test_mix_on_edges(spark):
    got = curriculum.assign(rows_of(spark)).toPandas()
    assert len(got) == len(ROWS) and (got[got["size"] == 0].taken == 0).all()
    assert curriculum.assign(rows_of(spark, []).limit(0)).count() == 0


# --- lines ----------------------------------------------------------------------------


def normal(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def edits(a, b):
    """Levenshtein distance, a column of the table in one integer (Myers)."""
    at = collections.defaultdict(int)
    for i, c in enumerate(a):
        at[c] |= 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:
        eq = at[c] | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (~(h | up) & full), up & h
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | (~((at[c] | down) | plus) & full), plus & (at[c] | down)
    return score


def near(a, b):
    longer = max(len(a), len(b))
    return 10 * abs(len(a) - len(b)) <= longer and 10 * edits(a, b) <= longer


def kept_by_brute_force(rows):
    """Texts left when of each group of lines by edit similarity alone the first stays."""
    known = sorted({normal(x) for _, t in rows for x in (t or "").split("\n")} - {""})
    root = {x: x for x in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(known):
        for b in known[:i]:
            if find(a) != find(b) and near(a, b):
                root[find(a)] = find(b)
    seen, want = set(), {}
    for i, t in rows:
        left = []
        for x in (t or "").split("\n"):
            if not normal(x) or find(normal(x)) not in seen:
                left.append(x)
            if normal(x):
                seen.add(find(normal(x)))
        want[i] = None if t is None else "\n".join(left)
    return want


def test_lines_against_brute_force(spark):
    rng = random.Random(10)
    base = [" ".join(f"{rng.choice('bcdfg')}{rng.randrange(500)}" for _ in range((9, 30, 160)[n % 3])) for n in range(30)]
    rows = []
    for i in range(90):
        said = []
        for _ in range(rng.randint(1, 4)):
            words = rng.choice(base).split()
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] += "x"
            line = " ".join(words)
            said.append(f"{line.upper()}!" if rng.random() < 0.3 else line)
        rows.append((i, "\n".join(said)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "x y"), (204, "x y"), (205, LONG), (206, LONG)]
    got = {r.doc_id: r.text for r in lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == kept_by_brute_force(rows)


def test_crowded_buckets_are_looked_at_again(spark):
    """Many variants of lines that are not in the corpus themselves: several rounds."""
    rng, rows = random.Random(23), []
    for n in range(4):
        base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(60)]
        for _ in range(40):
            words = list(base)
            for at in rng.sample(range(60), rng.randint(1, 7)):
                words[at] = "".join(rng.choices("klmnop", k=6))
            rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: r.text for r in lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == kept_by_brute_force(rows)


def test_near_lines_are_found_by_edit_similarity_alone(spark):
    """Recall of candidates: one character changed, and a tenth of the characters at most
    in changed words, at 2 to 300 words."""
    rng, rows, sizes = random.Random(17), [], (2, 3, 8, 12, 20, 40, 100, 300)
    for n in range(400):
        words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(sizes[n % 8])]
        changed = list(words)
        for at in rng.sample(range(len(words)), 1 if n < 200 else max(1, len(words) // 15)):
            changed[at] = words[at][:5] + "x" if n < 200 or len(words) < 15 else "".join(rng.choices("klmnop", k=6))
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(changed))]
        assert near(rows[-1][1], rows[-2][1])
    lines_ = spark.createDataFrame(rows, "id long, norm string").withColumn("size", F.length("norm"))
    places = lines.fingerprints(lines_.withColumn("short", F.when(F.col("size") < lines.SHORT, F.col("norm"))))
    met = lines.entries(places).groupBy("key").agg(F.collect_set("id").alias("ids")).collect()
    found = {n for r in met for n in {i // 2 for i in r.ids} if {2 * n, 2 * n + 1} <= set(r.ids)}
    for k, size in enumerate(sizes):
        recall = sum(n % 8 == k for n in found) / 50
        assert recall == 1 if size <= 3 else recall >= 0.9, (size, recall)


def test_simhashes_are_majorities(spark):
    rng = random.Random(5)
    rows = [(n, " ".join(f"w{rng.randrange(40)}" for _ in range(n))) for n in range(1, 120)]
    known = {r.w: r.h for r in spark.createDataFrame([(f"w{i}",) for i in range(40)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    got = {r.id: r.sim & (1 << 64) - 1 for r in lines.simhashes(spark.createDataFrame(rows, "id int, norm string")).collect()}
    assert got == {n: sum(1 << b for b in range(64) if sum(known[w] >> b & 1 for w in x.split()) > n // 2) for n, x in rows}


def test_lines_of_few_words_are_dropped(spark):
    han = "".join(chr(0x4E00 + 7 * i) for i in range(60))
    texts = ["Read more", "read more!", "--", "--", "ok", "on", "Ok.", "international", "internationel", han, han, han[:30] + "一" + han[31:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = lines.deduplicate_lines(docs).where("n_dropped > 0")
    assert sorted(r.doc_id for r in out.collect()) == [1, 6, 8, 10, 11]


def test_similarity_of_lines_is_exact_at_any_length(spark):
    long_ = "".join(random.Random(3).choices("abcdefg ", k=10_000))
    edited = "".join("x" if i % 33 == 0 else c for i, c in enumerate(long_))
    rows = [(1, long_, edited), (2, "abcdefghij", "abcdefghix"), (3, "a" * 50, "a" * 45 + "b" * 5), (4, "a" * 100, "a" * 90 + "b" * 10)]
    rows += [(5, "abcdefghi", "abcdefghx"), (6, "a" * 50, "a" * 44 + "b" * 6), (7, "a" * 3000, "a" * 2699 + "b" * 301)]
    found = spark.createDataFrame(rows, "id long, a string, b string").where(lines._similar("a", "b"))
    assert sorted(r.id for r in found.collect()) == [1, 2, 3, 4]


def test_lines_on_edges(spark):
    out = lines.deduplicate_lines(rows_of(spark)).toPandas()
    assert len(out) == len(ROWS) and out[out.doc_id == 1].text.iloc[0] == ROWS[0][1] and out[out.doc_id == 6].text.tolist() == ["", ""]
    assert lines.deduplicate_lines(rows_of(spark, []).limit(0)).count() == 0


def test_lines_carry_columns_of_any_name(spark):
    names = ("_id", "_key", "_own", "_gone", "_lines", "_row", "_own_id", "text_key", "line_no", "root", "n_dropped")
    docs = rows_of(spark).withColumns({c: F.lit("x") for c in names})
    out = lines.deduplicate_lines(docs)
    assert set(out.columns) == set(docs.columns) | {"n_lines"} and out.where(" or ".join(f"{c} <> 'x'" for c in names[:-1])).count() == 0


def test_registry_is_complete(spark):
    assert [re.match(r"op\d+_", n)[0] for n in queries.queries()] == [f"op{n}_" for n in range(1, 14)]
    assert pd.Series(list(queries.oracle_sql())).isin(queries.queries()).all()
