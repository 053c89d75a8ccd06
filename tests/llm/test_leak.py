import pickle
import random

from tidemark.llm.leak import LeakIndex, find_leaks, words_of


def brute(docs, items, run):
    def grams(text):
        words = words_of(text)
        return {tuple(words[i:i + run]) for i in range(len(words) - run + 1)}

    d, i = [(k, grams(t)) for k, t in docs], [(k, grams(t)) for k, t in items]
    return sorted((a, b) for a, x in i for b, y in d if x & y)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randrange(5, 40))) for i in range(60)]
    docs = []
    for d in range(80):
        text = say(rng.randrange(0, 400)).split(" ")
        if rng.random() < 0.5:
            words = rng.choice(items)[1].split(" ")
            a = rng.randrange(len(words))
            part = words[a:a + rng.randrange(4, 20)]
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w.upper() if rng.random() < 0.3 else w for w in part]
        docs.append((d, (" , " if d % 2 else " ").join(text)))
    return docs, items


def test_matches_brute_force(spark):
    for seed, shard in ((1, 2_000_000), (2, 400)):
        docs, items = corpus(seed)
        docs += [(1000, None), (1001, ""), (0, docs[0][1])]
        items += [(1000, None), (1001, "too short"), (0, items[0][1])]
        d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string")
        i = spark.createDataFrame([(k, t, 5) for k, t in items], "item_id bigint, text string, doc_id int")
        for passage in (32, 20):
            got = find_leaks(d, "doc_id", "text", i, "item_id", "text", run=8, passage=passage, shard_words=shard)
            assert sorted(map(tuple, got.collect())) == sorted(set(brute(docs, items, 8)))


def test_several_passes(spark):
    docs, items = corpus(4)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = find_leaks(d, "doc_id", "text", i, "item_id", "text", run=8, shard_words=300, shards_a_pass=2)
    assert sorted(map(tuple, got.collect())) == brute(docs, items, 8)


def test_blocks_lose_nothing_and_the_index_is_small():
    docs, items = corpus(6)
    texts = [words_of(t) for _, t in docs]
    for block in (1, 2, 64):
        index = LeakIndex([(i, words_of(t)) for i, t in items], run=8, block=block)
        encoded = [index.encode(w) for w in texts]
        found = index.verify(index.retrieve(encoded, 20), encoded)
        assert sorted((index.keys[j], docs[d][0]) for d, j in found) == brute(docs, items, 8)
    rng = random.Random(2)
    many = [(i, [f"w{int(rng.paretovariate(0.7))}" for _ in range(100)]) for i in range(300)]
    assert len(pickle.dumps(LeakIndex(many))) < 125 * 30_000  # 2,000,000 words stay under 250 MB


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, text string")
    assert find_leaks(d, "doc_id", "text", i, "item_id", "text").count() == 0
    assert find_leaks(d.limit(0), "doc_id", "text", d.selectExpr("doc_id item_id", "text"), "item_id", "text").count() == 0


def test_no_passage_with_a_run_scores_below_the_threshold():
    docs, items = corpus(3)
    index = LeakIndex([(i, words_of(t)) for i, t in items], run=8)
    for j, key in enumerate(index.keys):
        words = dict((i, words_of(t)) for i, t in items)[key]
        for a in range(len(words) - 7):
            assert (0, j) in index.retrieve([index.encode(words[a:a + 8])])


def test_a_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(12))
    d = spark.createDataFrame([(1, "filler words here " * 60_000 + item), (2, "filler " * 10)], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert [tuple(r) for r in find_leaks(d, "doc_id", "text", i, "item_id", "text").collect()] == [(7, 1)]
