"""Only stretches that can hold a repeated window reach an index; rows are found by id and tag."""

import random

import numpy as np
import pyarrow as pa

from spanloom.llm import repeats, substrings


def test_stretches_that_share_a_gram_alone_are_not_indexed(spark):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    phrase = some(45)
    df = spark.createDataFrame([(i, some(200) + phrase + some(200)) for i in range(30)], "doc_id bigint, text string")

    def method(bodies, base, windows):
        raise AssertionError("no window of these occurs twice")

    out = repeats.remove(df, substrings.PLAN, method, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
                         [pa.int64(), pa.int64(), pa.int64(), pa.string()], substrings.kept, "doc_id", "text").collect()
    assert len(out) == 30 and all(r.n_bytes == 445 and r.n_removed == 0 for r in out)


def test_stretches_of_repeated_windows_are_told_by_hash():
    rng = np.random.default_rng(5)
    body = lambda n: rng.integers(97, 110, n, np.uint8).tobytes()
    same, other = body(52), body(49)
    bodies = [body(20) + same, same + body(9), body(7) + other, other + body(7), body(60)]
    assert repeats.shared(substrings.PLAN, bodies, np.array([len(b) - 49 for b in bodies])).tolist() == [True, True, False, False, False]


def test_rows_by_id_and_tag():
    ids, tag = np.array([5, -9, 5, 5, 1 << 62]), np.array([1, 2, 3, 1, 0], np.uint16)
    want_id, want_tag = np.array([5, 5, -9, 7, 1 << 62, 1 << 62, 5]), np.array([3, 1, 2, 1, 0, 9, 4], np.uint16)
    assert repeats.rows_of(ids, tag, want_id, want_tag).tolist() == [2, 0, 1, -1, 4, -1, -1]
