"""Token counts, SentencePiece and binary output against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from basalt.llm import binary_output, sentencepiece_codec, token_counts  # noqa: E402

BYTE_BPE = P.path("byte_bpe_50k.json")


def model():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(BYTE_BPE)
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    return made


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    parts = [*" \n\t\u00a0ab'1!é▁日🙂\0\r\u2028", " ", " ", " ", "<|endoftext|>", " word", "'s", "the", "  ", "ing"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_pieces_are_encoded_as_whole_texts_are(library):
    texts = [*odd_texts(3000), None, ""]
    seen = token_counts.Pieces(BYTE_BPE, limit=500)
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        starts, lengths, bounds = seen.of(pa.array(part, pa.string()))
        for k, text in enumerate(part):
            a, b = bounds[k], bounds[k + 1]
            assert token_counts.gathered(seen.ids, starts[a:b], lengths[a:b]).tolist() == library(text), text


def test_counts(spark, odd, odd_rows, none, library):
    df = odd.withColumn("n_tokens", F.lit("mine"))
    found = token_counts.count_tokens(df, BYTE_BPE).orderBy("doc_id", "n_bytes").collect()
    wanted = sorted(((i, len((t or "").encode()), len(library(t))) for i, t, *_ in odd_rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in found] == [(*w, w[2] > 512) for w in wanted]
    assert {"lang", "source"} <= {*found[0].asDict()}
    assert token_counts.count_tokens(none, BYTE_BPE).count() == 0


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 255, 256, 257, 5000])
@pytest.mark.parametrize("kind", range(5))
def test_simple8b_round_trip(n, kind):
    rng = np.random.default_rng(n)
    mixed = np.where(rng.random(n) < 0.1, rng.integers(0, 1 << 63, n) * 2 + 1, rng.integers(0, 4, n))
    ids = [rng.integers(0, 50_257, n), rng.integers(0, 2, n), mixed, np.full(n, (1 << 64) - 1, np.uint64), np.zeros(n)][kind].astype(np.uint64)
    body = binary_output.encode(ids)
    assert np.array_equal(binary_output.decode(body), ids)
    assert np.array_equal(binary_output.decode(body, 1, 1), ids[256:512])


def test_simple8b_is_compact_and_checked():
    assert len(binary_output.encode(np.ones(6000, np.uint64))) < 6000 / 8 * 1.6
    with pytest.raises(ValueError):
        binary_output.decode(b"nothing here")


def test_files(spark, odd, odd_rows, none, library, tmp_path):
    found = binary_output.token_files(odd.repartition(3), BYTE_BPE, folder=str(tmp_path / "f")).orderBy("start").collect()
    start = 0
    for (i, text, *_), r in zip(sorted(odd_rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")), found, strict=True):
        ids = [*library(text), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert binary_output.token_files(none, BYTE_BPE, folder=str(tmp_path / "g")).count() == 0


def test_suffix_array_encoding_is_the_library_s(pieces, prose):
    rng = random.Random(1)
    some = [pieces.id_to_piece(i) for i in range(259, 32_000)]
    glued = ["".join(rng.choice(some) for _ in range(rng.randint(1, 8))).replace("▁", " ") for _ in range(3000)]
    texts = [*odd_texts(2000), *glued, "a" * 5000, "ab" * 3000, prose(4, 3000)]
    made = sentencepiece_codec.codec(model())
    starts, lengths, bounds = made.of(pa.array(texts))
    for k, (text, wanted) in enumerate(zip(texts, pieces.encode(texts), strict=True)):
        ids = token_counts.gathered(made.ids, starts[bounds[k] : bounds[k + 1]], lengths[bounds[k] : bounds[k + 1]])
        assert ids.tolist() == wanted, text[:80]
        assert made.decode(ids, np.array([0, len(ids)]))[0] == pieces.decode(wanted)


def test_every_occurrence_is_an_edge():
    made = sentencepiece_codec.codec(model())
    text = np.frombuffer(b" the theing\xff is\xff", np.uint8)
    start, end, piece = made.edges(text)
    found = {(int(a), int(b)) for a, b in zip(start, end, strict=True)}
    raw, known = text.tobytes(), {x for x in made.model.surfaces if x}
    assert found == {(a, b) for a in range(len(raw)) for b in range(a + 1, len(raw) + 1) if raw[a:b] in known}
    assert all(made.model.surfaces[p] == raw[a:b] for a, b, p in zip(start, end, piece, strict=True))


def test_encoding_and_decoding_of_tables(spark, odd, odd_rows, none, pieces):
    encoded = sentencepiece_codec.encode(odd, model(), check=True)
    rows = sentencepiece_codec.decode(encoded, model()).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in rows) == sorted((i or 0, pieces.encode(t or "")) for i, t, *_ in odd_rows)
    assert all(r.round_trip and r.decoded == (r.text or "").replace("▁", " ") and r.n_tokens == len(r.ids) for r in rows)
    assert sentencepiece_codec.encode(none, model()).count() == 0
    assert "ids" not in sentencepiece_codec.encode(odd, model(), ids=False).columns


def test_other_models_are_refused():
    with pytest.raises(Exception):  # noqa: B017
        sentencepiece_codec.load(b"nothing")
