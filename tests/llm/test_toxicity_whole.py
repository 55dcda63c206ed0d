"""Training reads every feature of a text, however many it has."""

from itertools import product

from gritsieve.llm import toxicity


def test_long_texts_train_on_all_features(spark):
    options = toxicity.ToxicityOptions()
    filler = [f"{k:04d}filling" for k in range(2500)]
    # too short for beginnings: the feature with the highest number that toxic texts alone have
    term = max(("".join(x) for x in product("abcdefgh", repeat=3)), key=lambda w: toxicity.features([w.encode()], options.buckets)[0])
    number = int(toxicity.features([term.encode()], options.buckets)[0])
    common = toxicity.features([w.encode() for w in filler], options.buckets)
    assert (common < number).sum() > 8192 and number not in common
    rows = [(k, " ".join([*filler, term] if k % 2 else filler)) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k, _ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, options)
    held = dict(zip(model.numbers.tolist(), model.weights))  # beside it only numbers that a term shares by chance
    assert held[number] == max(held.values()) > 0 and len(held) < 10 + len(toxicity.TERMS)
