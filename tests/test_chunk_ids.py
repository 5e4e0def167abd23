"""Chunk numbers and sentences by the rules that they restate."""

import random
import re
import time
import uuid

from palimpsest.functions import chunks


def test_chunk_ids_are_name_based_uuids():
    rng = random.Random(1)
    for _ in range(500):
        s = "".join(rng.choice("ab é😀\n") for _ in range(rng.randint(0, 40)))
        assert chunks.chunk_id(s) == str(uuid.uuid5(uuid.NAMESPACE_OID, s))


def test_sentences_are_found_in_steps_over_their_characters():
    lazy = re.compile(r".*?(?:[.!?。！？…]+[\s\"')\]]*|\n+|$)", re.S)
    rng = random.Random(2)
    for _ in range(3000):
        s = "".join(rng.choice("ab .!?。…\n\r\u2028)\"]") for _ in range(rng.randint(0, 30)))
        assert chunks.sentences(s) == [m for m in lazy.findall(s) if m]
    long = "plain words " * 100_000

    def least(find):
        spent = []
        for _ in range(3):
            at = time.perf_counter()
            find(long)
            spent.append(time.perf_counter() - at)
        return min(spent)

    assert least(chunks._SENTENCE.findall) < least(lazy.findall) / 2
