import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import chat, decontam, langid, packing, quality, rules, sharding, simhash
from tests.llm.data import documents, rows, saved, sentence

CHAT = "conv_id long, turn long, role string, text string"


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return Counter(con.execute(sql).fetchall())


# ---- chat


def chats():
    return [
        (1, 0, "system", "be <|im_end|> kind & <|turn|> good"), (1, 1, "user", "hi"), (1, 2, "user", "again &lt;| &amp;"), (1, 3, "assistant", "yes\n<|im_start|>"),
        (1, 4, "assistant", None), (2, 0, "assistant", "é<"), (2, 0, "assistant", "é<"), (2, 1, "odd\nrole<|", "|x"), (3, 5, None, ""), (None, 0, "user", "lone"),
        (4, None, "user", "no turn"), (4, 1, "user", "same <| turn"), (4, 1, "user", "same = turn"), (4, 1, "user", "same turn b"), (4, 1, "user", "same turn a"), (5, 0, "assistant", "x" * 50_000),
    ]


def test_chat_equals_sql(spark, tmp_path):
    c = spark.createDataFrame(chats(), CHAT).withColumn("formatted", F.lit("clash"))
    got = chat.op5_chat(spark, saved(spark, tmp_path, conversations=c))
    assert Counter(tuple(r) for r in got.collect()) == oracle(chat.OP5_SQL, conversations=c)


def test_chat_round_trip_and_mask(spark):
    c = spark.createDataFrame(chats(), CHAT)
    for r in chat.read_back(chat.format_chats(c)).collect():
        safe = lambda x: (x or "").replace("&", "&amp;").replace("<|", "&lt;|")  # noqa: E731  ties follow the escaped texts
        own = sorted((x for x in chats() if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, safe(x[2]), safe(x[3])))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("<|im_start|>") == sum(a[2] != b[2] for a, b in zip(own, own[1:])) + 1
    assert chat.format_chats(c.limit(0)).count() == 0


# ---- rules


@pytest.mark.parametrize("values", [rows(), []], ids=["hard", "empty"])
def test_rules_equal_sql(spark, tmp_path, values):
    d = documents(spark, values).withColumn("n_words", F.lit("clash"))
    got = rules.op8_rules(spark, saved(spark, tmp_path, documents=d))
    assert Counter(tuple(r) for r in got.collect()) == oracle(rules.OP8_SQL, documents=d)


def test_cascade_order_never_changes_the_verdict(spark):
    d = documents(spark)
    own = rules.cascade_rules()
    a, b = (rules.judge(d, r).select("doc_id", "text", "kept") for r in (own, own[::-1]))
    assert a.exceptAll(b).count() == 0


def test_rules_are_ordered_by_rejections_of_what_is_left():
    # rule 0 rejects most for its cost; after it, rule 2 has nothing left, though it alone rejects more than rule 1
    assert rules.by_worth([1.0, 1.0, 1.0], {0b101: 10, 0b010: 3, 0b001: 2, 0: 50}) == [(0, 12), (1, 3), (2, 0)]
    assert [k for k, _ in rules.by_worth([5.0, 0.1, 1.0], {0b001: 9, 0b010: 1, 0b100: 3})] == [1, 2, 0]


def test_cost_is_the_rule_and_not_the_job(spark):
    featured = rules.with_features(documents(spark).select("text"))
    free, dear = rules.Rule("free", F.col("n_words") > 5), rules.Rule("dear", F.exists("w", lambda x: F.sha2(F.repeat(x, 200), 256) == "x"))
    n = [r.out for r in featured.select(rules.base_failed().alias("out")).collect()].count(False)
    for pair in ([free, dear], [dear, free]):
        costs, rejected = rules.measured(featured, pair)
        a, b = costs if pair[0] is free else costs[::-1]
        assert a < b / 10
        assert rejected == {1 if pair[0] is free else 2: n}
        assert [r.name for r in rules.ordered(documents(spark), pair, 1000)] == ["free", "dear"]


def test_rules_are_timed_in_one_job_and_every_time(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("timed", "timed")
    rules.ordered(documents(spark), rules.cascade_rules(), 10)
    assert len(tracker.getJobIdsForGroup("timed")) <= 12
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    dear = F.length(F.sha2(F.repeat(F.col("id").cast("string"), 100_000), 256)) < 1
    once = spark.range(1).select(rules.timed(dear, 1).ns).first()[0]
    assert once > 20_000  # all of the digest lies between the readings


# ---- sharding


def test_room_tree_and_best_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 400).tolist()
    rooms, want = [], []
    for i in sorted(range(400), key=lambda i: (-sizes[i], i)):
        fit = [(r, b) for b, r in enumerate(rooms) if r >= sizes[i]]
        r, b = min(fit) if fit else (100, len(rooms))
        if not fit:
            rooms.append(100)
        rooms[b] = r - sizes[i]
        want.append((i, b))
    got = sharding.best_fit_decreasing(sizes, 100)
    assert all(got[i] == b for i, b in want)


@pytest.mark.parametrize("values", [rows(), [(i, "the same text", "en", "s", 1) for i in range(30)] + rows(2), []], ids=["hard", "hot", "empty"])
def test_shards(spark, tmp_path, values):
    got = sharding.op9_sharding(spark, saved(spark, tmp_path, documents=documents(spark, values))).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((v[0], len((v[1] or "").encode()) + 1, zlib.crc32((v[1] or "").encode())) for v in values)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        homes[r.text_crc32, r.size].add(r.shard)
        assert 0 <= r.shard < 8 and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())


def test_shards_are_even(spark, tmp_path):
    rng = np.random.default_rng(5)
    values = [(i, "y" * int(n), "en", "s", 1) for i, n in enumerate(rng.integers(1, 4000, 3000))]
    got = sharding.shard(documents(spark, values)).groupBy("shard").agg(F.sum("size")).collect()
    assert len(got) == 8 and max(r[1] for r in got) <= 1.01 * min(r[1] for r in got)


# ---- simhash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(prints))]


@pytest.mark.parametrize("values", [rows(), []], ids=["hard", "empty"])
def test_simhash(spark, tmp_path, values):
    got = simhash.op10_simhash(spark, saved(spark, tmp_path, documents=documents(spark, values)))
    prints = [brute_fingerprint(v[1]) for v in values]
    want = Counter((v[0], f"{p:016x}", c) for v, p, c in zip(values, prints, brute_components(prints, [v[0] for v in values]), strict=True))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_bk_trees_link_all_and_only_near_prints(spark):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    prints = {int(s) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))) for s in seeds for _ in range(40)}
    prints = np.array(sorted(prints), np.uint64)
    want = brute_components([int(p) for p in prints], list(range(len(prints))))
    assert simhash.tree_links(prints).tolist() == want
    df = spark.createDataFrame([(i, int(p.view(np.int64))) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.components(df).collect()}
    assert [got[i] for i in range(len(prints))] == want


def test_one_of_each_keeps_the_smallest(spark):
    d = documents(spark, [(5, "a b c d", "en", "s", 1), (2, "a b c d", "en", "s", 1), (9, "quite another text here", "en", "s", 1), (2, "a b c d", "en", "s", 1)])
    out = simhash.one_of_each(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [2, 9]


# ---- language and quality


def spoken(seed, n=60):
    import random

    rng = random.Random(seed)
    words = {"en": "the with river stone thing when", "de": "und nicht über straße schön mit", "fr": "les être où déjà avec chez"}
    return [(i, " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(4, 40))), lang, "s", 1) for i in range(n) for lang in [sorted(words)[i % 3]]]


def test_language_is_told_on_held_out_rows(spark, tmp_path):
    values = spoken(1) + [(900, None, "en", "s", 1), (901, "12 ?!", "en", "s", 1), (902, "", None, "s", 1), (903, "und nicht mit", None, "s", 1)]
    d = documents(spark, values).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.op1_langid(spark, saved(spark, tmp_path, documents=d)).collect()}
    lang = {v[0]: v[2] for v in values}
    held = [r for r in got.values() if r.held_out and r.doc_id < 900]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_without_anything_to_learn(spark):
    assert langid.train(documents(spark, []).select("text", "lang")) is None
    out = langid.identify(documents(spark, rows()), None)
    assert {r.lang_pred for r in out.collect()} == {"und"} and out.count() == len(rows())
    d = documents(spark, spoken(2) + [(900, "...", "en", "s", 1)])
    for c in ("score", "_lang", "lang_pred", "_guess"):
        d = d.withColumn(c, F.lit(c))
    kept = langid.accepted(d)
    assert kept.columns == d.columns and kept.count() == 60
    assert {(r.score, r._lang, r.lang_pred, r._guess) for r in kept.collect()} == {("score", "_lang", "lang_pred", "_guess")}
    assert langid.identify(d, None).columns == [*(c for c in d.columns if c not in ("score", "lang_pred")), "lang_pred", "score", "lang_ambiguous"]


def test_codewords_are_apart():
    for n in (2, 4, 6, 12):
        c = langid.codewords(n)
        apart = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else c.shape[1] // 4)


def test_quality_on_held_out_rows(spark, tmp_path):
    import random

    rng = random.Random(3)
    values = [(i, sentence(rng, 30) if i % 3 else sentence(rng, 10).replace(" ", "### ") + "!!", "en", "s", 1) for i in range(120)] + [(800, None, "en", "s", 1), (801, "", "en", "s", 1)]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(0, 120)] + [(7777, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.op4_quality(spark, saved(spark, tmp_path, documents=documents(spark, values), labels=labels)).collect()}
    assert len(got) == 122 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id < 120]
    assert sum(r.predicted == (1 if r.doc_id % 3 else 0) for r in held) >= 0.95 * len(held)
    assert got[800].score == got[801].score


def test_quality_with_one_class_or_none(spark):
    d = documents(spark, rows())
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in quality.score(d, quality.train(d, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (4, 1)], "doc_id long, label int")
    assert all(r.predicted == 1 for r in quality.score(d, quality.train(d, one)).collect())


# ---- decontamination


ITEMS = [(1, "Who built the tall tower of the old harbour town? The twelve masons of the northern guild built it alone."), (2, "short one"), (3, None), (4, ""), (5, "Who built the tall tower of the old harbour town? The twelve masons of the northern guild built it alone.")]


def test_decontamination_finds_planted_items(spark, tmp_path):
    import random

    rng = random.Random(8)
    item = ITEMS[0][1]
    values = [(i, sentence(rng, 80), "en", "s", 1) for i in range(20)] + [
        (100, sentence(rng, 90) + " " + item.upper() + " " + sentence(rng, 90), "en", "s", 1), (101, item, "en", "s", 1), (102, "the tall tower of the old harbour town", "en", "s", 1),
        (103, None, "en", "s", 1), (104, "", "en", "s", 1), (105, "a short one here", "en", "s", 1), (101, item, "en", "s", 1),
    ]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("clash"))
    d = documents(spark, values)
    got = decontam.op2_decontam(spark, saved(spark, tmp_path, documents=d, benchmark=bench)).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter({(100, 1): 1, (100, 5): 1, (101, 1): 2, (101, 5): 2, (105, 2): 1})
    kept = decontam.clean(d, bench)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {v[0] for v in values} - {100, 101, 105}
    assert decontam.contaminated(d, bench.limit(0)).count() == 0 and decontam.contaminated(d.limit(0), bench).count() == 0


def brute_scores(index, terms):
    return {k: x for k in range(len(index.ids)) if (x := sum(v for t in terms for d, v in zip(*index.postings[t][:2], strict=True) if d == k)) >= 0.6}


def test_wand_skips_blocks_and_finds_what_scoring_every_item_finds():
    import random

    rng = random.Random(9)
    index = decontam.Index([(i, sentence(rng, rng.randint(3, 25)) + f" k{i % 17} q{i % 5}") for i in range(300)])
    assert max(len(p[2]) for p in index.postings) > 20
    found, every = 0, range(index.most.shape[1])
    for _ in range(100):
        q = set(rng.sample(range(len(index.vocab)), rng.randint(1, len(index.vocab) // 2)))
        want = brute_scores(index, q)
        got = dict(index.wand(every, sorted(q)))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
        parts = [x for a in range(0, every.stop, 5) for x in index.wand(range(a, min(a + 5, every.stop)), sorted(q))]
        assert dict(parts).keys() == want.keys()
        found += len(want)
    assert found and index.skipped > 100


def brute_hits(values, items):
    """(doc_id, item_id) from the BM25 share of every item in every passage, and naive overlaps."""
    import math

    index = decontam.Index([i for i in items if i[1] is not None])
    seqs = {k: decontam.tokens(t) for k, (_, t) in enumerate(items) if t and decontam.tokens(t)}
    mean, df = sum(map(len, seqs.values())) / len(seqs), Counter(w for s in seqs.values() for w in set(s))
    cell = max(map(len, seqs.values()))
    weight = lambda k, w: math.log(1 + (len(seqs) - df[w] + 0.5) / (df[w] + 0.5)) * (f := seqs[k].count(w)) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(seqs[k]) / mean))

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, last = [0], row
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
        return row[-1]

    out = Counter()
    for doc, text, *_ in values:
        w = decontam.tokens(text or "")
        found = set()
        for at in range(0, len(w), cell):
            passage = w[at : at + 2 * cell]
            for k, s in seqs.items():
                if sum(weight(k, x) for x in set(s) & set(passage)) < 0.6 * sum(weight(k, x) for x in set(s)) - 1e-9:
                    continue
                n, cut_ = min(5, len(s)), decontam.answer_start(items[k][1])
                own = {tuple(s[i : i + n]) for i in range(len(s) - n + 1)}
                held = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
                parts = [p for p in (s[:cut_], s[cut_:]) if p]
                if len(own & held) >= 0.8 * len(own) and all(lcs(p, passage) >= 0.8 * len(p) for p in parts):
                    found.add(items[k][0])
        out.update((doc, i) for i in found)
    assert index.cell == cell
    return out


@pytest.mark.parametrize("part", [2 << 20, 300])
def test_decontamination_equals_brute_force(spark, tmp_path, monkeypatch, part):
    import random

    monkeypatch.setattr(decontam, "PART_BYTES", part)
    rng = random.Random(4)
    words = [f"v{i}" for i in range(150)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{text(rng.randint(4, 30))}? {text(rng.randint(1, 12))}.") for i in range(30)] + [(50, "v1 v2"), (51, None), (52, "??")]
    values = [(i, text(rng.randint(0, 200)), "en", "s", 1) for i in range(20)] + [(90, None, "en", "s", 1), (91, text(8_000), "en", "s", 1)]
    for i in range(40):
        w = items[i % 30][1].split()
        for _ in range(i // 10):
            w[rng.randrange(len(w))] = "changed"
        values.append((100 + i, f"{text(rng.randint(0, 60))} {' '.join(w)} {text(rng.randint(0, 60))}", "en", "s", 1))
    values.append((200, "v1 v2", "en", "s", 1))
    d = saved(spark, tmp_path, documents=documents(spark, values), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r.doc_id, r.item_id) for r in decontam.op2_decontam(spark, d).collect())
    want = brute_hits(values, items)
    assert got == want and len(want) > 15 and (200, 50) in want


def test_clean_leaves_columns_alone(spark):
    item = ITEMS[0][1]
    d = documents(spark, [(1, item, "en", "s", 1), (2, "clean text", "en", "s", 1)]).withColumn("_hits", F.lit("x")).withColumn("score", F.lit("y"))
    got = decontam.clean(d, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert got.columns == d.columns and [tuple(r) for r in got.collect()] == [(2, "clean text", "en", "s", 1, "x", "y")]


# ---- packing


@pytest.mark.parametrize("values", [rows(), []], ids=["hard", "empty"])
def test_packing(spark, tmp_path, values):
    import public_tokenizers
    from tokenizers import Tokenizer

    values = values + ([(700, "words of many kinds " * 3000, "en", "s", 1), (701, "mark <|endoftext|> inside", "en", "s", 1)] if values else [])
    got = packing.op3_packing(spark, saved(spark, tmp_path, documents=documents(spark, values))).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for v in values:
        ids = [*tok.encode(v[1] or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(min(first, len(ids)), len(ids), 2048), len(ids)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want[v[0], k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1


def test_groups_keep_every_piece():
    rng = np.random.default_rng(4)
    counts = np.bincount(rng.integers(1, 2048, 3000), minlength=2049)
    best = packing.best_fit_decreasing(counts)
    rooms = []
    for x in np.repeat(np.arange(2049), counts)[::-1].tolist():
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 2048) - x)
    assert packing.size(best) == len(rooms) >= packing.least_sequences(counts)
    population, crossovers = packing.evolve([best, *(packing.mutation(best, rng) for _ in range(3))], 0, rng, 3)
    assert crossovers >= 3
    for groups in population:
        held = np.zeros(2049, int)
        for p, n in groups.items():
            assert sum(p) <= 2048 and n > 0
            for x in p:
                held[x] += n
        assert (held == counts).all()
    assert packing.size(population[0]) <= len(rooms)


def test_islands_migrate(spark):
    counts = np.bincount(np.random.default_rng(6).integers(300, 1500, 400), minlength=2049)
    groups, report = packing.evolved(spark, counts, islands=2, epochs=2)
    assert report.bound <= packing.size(groups) == report.found <= report.best_fit == packing.size(packing.best_fit_decreasing(counts))
    held = sum(np.bincount(p, minlength=2049) * n for p, n in groups.items())
    assert (held == counts).all() and report.crossovers > 0
    assert packing.evolved(spark, np.zeros(2049, np.int64))[0] == {}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_crossovers_make_the_plan(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    counts = np.zeros(2049, np.int64)
    for x, n in packing.pieces(docs).groupBy("length").count().collect():
        counts[x] = n * (x < 2048)
    _, report = packing.evolved(spark, counts)
    assert report.crossovers > 0 and report.bound <= report.found <= report.best_fit


def test_guests_from_best_fit_keep_the_result_from_falling_behind(spark):
    counts = np.bincount(np.random.default_rng(7).integers(20, 900, 3000), minlength=2049)
    _, report = packing.evolved(spark, counts, islands=2, epochs=1)
    assert report.found <= report.best_fit and report.epochs <= 2


def test_portions_hold_all_texts_in_order():
    texts = ["a" * 5, None, "b" * 30, "", "c" * 9, "d"]
    got = list(decontam.portions(texts, 10))
    assert [t for p in got for t in p] == texts and got == [["a" * 5, None], ["b" * 30], ["", "c" * 9, "d"]] and list(decontam.portions([])) == []
