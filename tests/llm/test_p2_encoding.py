"""Every decipherment of a token competes with its cipher's weight."""

import numpy as np
import pandas as pd

from folioweave.llm import p2_encoding as p2


class Model:
    """Likes the readings in this order, each by less than a cipher's weight."""

    def __init__(self, order):
        self.order = order

    def known(self, ch):
        return True

    def score(self, folded):
        return -50.0 + (20.0 - 0.1 * self.order.index(folded) if folded in self.order else 0.0)


TOKEN = "река".encode("koi8_r").decode("cp1251")
TRUE = "река"
PAIR = p2.PAIRS.index(("cp1251", "koi8_r"))


def test_a_reading_that_ranks_low_wins_under_a_well_known_cipher():
    rivals = sorted({d.lower() for d in p2.readings(TOKEN)} - {TRUE})
    assert len(rivals) > 5
    got = p2._best(TOKEN, Model([*rivals[:5], TRUE]), {PAIR: 0.9})
    assert got[:2] == (TRUE, PAIR)


def test_a_reading_keeps_every_pair_that_gives_it():
    for token in (TOKEN, "é".encode().decode("latin-1") + "cole"):
        for d, ks in p2.readings(token).items():
            for k in ks:
                assert p2.decipher(token, *p2.PAIRS[k]) is not None
    shared = next(ks for ks in p2.readings("Ã©cole").values() if len(ks) > 1)
    token, reading = "Ã©cole", "école"
    k = p2.readings(token)[reading][-1]
    assert k in shared and p2._best(token, Model([reading]), {k: 0.9})[:2] == (reading, k)


def test_the_sketch_and_the_sieve_reach_the_driver_in_blocks(spark, monkeypatch):
    rows = []
    for name in ("collect", "toPandas"):
        whole = getattr(type(spark.range(1)), name)
        monkeypatch.setattr(type(spark.range(1)), name, lambda df, whole=whole: rows.append(len(out := whole(df))) or out)
    tokens = ["é" + "".join(map(chr, x)) for x in np.random.default_rng(1).integers(0x400, 0x9000, (5000, 4))]
    df = spark.createDataFrame(pd.DataFrame({"token": tokens, "n": 3}))
    two, one = p2.count_bigrams(df, "token")
    sieve = p2.sieve_of(df)
    assert rows and max(rows) <= max(2 * p2.BUCKETS + p2.UNIGRAMS, p2.SIEVE) / p2.BLOCK
    want_two, want_one, want = np.zeros(2 * p2.BUCKETS), np.zeros(p2.UNIGRAMS), np.zeros(p2.SIEVE, dtype=bool)
    for t in tokens:
        s2, s1 = p2._slots(p2._fold(t))
        np.add.at(want_two, s2, 3)
        np.add.at(want_one, s1, 3)
        want[p2._slot(t)] = True
    assert (two == want_two).all() and (one == want_one).all() and (sieve == want).all()


def test_weights_of_many_sources_are_not_broadcast(spark):
    sources = spark.createDataFrame([("a", {1: 2.0}, 5)], "source string, w map<int,double>, all long")
    decoder = p2.Decoder(np.zeros(2 * p2.BUCKETS), np.zeros(p2.UNIGRAMS), np.zeros(p2.SIEVE, dtype=bool), {}, sources)
    records = spark.createDataFrame([("chunks", "1", "a", "x \ufffd"), ("chunks", "2", "b", "\ufffd")], "rec_table string, rec_key string, source string, text string")
    got = p2.restored(records, decoder)
    assert {r["rec_key"] for r in got.collect()} == {"1", "2"}
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
