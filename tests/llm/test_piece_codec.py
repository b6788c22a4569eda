import random

import sentencepiece

from graphloom.llm.piece_codec import MODEL, SPACE, Codec, Encoder, Stream, decode, encode

ODD = ["", " ", "  ", "a", " a", "a ", "  a  b   c ", "\n", "\n\n a\n", "a\nb", " \n", "é́ ß", "日本語テキスト", "\U0001f600 ok", "a▁b ▁", "x" * 5000, "ab" * 3000, " " * 40 + "z", "\t\r\n x", "...,,,!!! ---", "The   quick  brown fox"]


def samples(n=400):
    r = random.Random(2)
    chars = "aetionhsrdl ETN.,\n\t  éßñ%$#0123456789▁日"
    return ODD + ["".join(r.choice(chars) for _ in range(r.randrange(60))) for _ in range(n)]


def test_bpe_ids_equal_the_library():
    codec, library = Codec.load(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = Encoder(codec)
    for t in samples():
        assert encoder.encode(t) == library.encode(t), t
        assert encoder.decode(encoder.encode(t)) == library.decode(library.encode(t)), t


def test_stream_keeps_a_short_window():
    codec = Codec.load()
    stream, out, most = Stream(codec), [], 0
    text = "".join(SPACE + w for w in ("internationalisation of the thing " * 300).split())
    for i in range(0, len(text), 7):
        out += stream.feed(text[i : i + 7])
        most = max(most, stream.held)
    out += stream.finish()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert out == library.encode(("internationalisation of the thing " * 300).strip())
    assert most < 200


def test_unigram_paths_equal_all_segmentations():
    r = random.Random(7)
    letters = "abc"
    pieces = ["<unk>", SPACE, *letters] + ["".join(r.choice(letters + SPACE) for _ in range(r.randrange(2, 5))) for _ in range(14)]
    pieces = list(dict.fromkeys(pieces))
    codec = Codec(pieces, [0.0] + [-r.random() * 5 - 1 for _ in pieces[1:]], [2] + [1] * (len(pieces) - 1), False)

    def best(t):
        found = {0: 0.0}
        for i in range(1, len(t) + 1):
            found[i] = max(found[j] + (codec.scores[codec.ids[t[j:i]]] if t[j:i] in codec.ids else codec.worst) for j in range(i) if t[j:i] in codec.ids or i - j == 1)
        return found[len(t)]

    for _ in range(200):
        t = "".join(r.choice("abcd" + SPACE) for _ in range(r.randrange(1, 150)))
        s = Stream(codec)
        ids = s.feed(t) + s.finish()
        value = sum(codec.scores[i] if i else codec.worst for i in ids)
        assert abs(value - best(t)) < 1e-6


def test_tables(spark):
    codec, library = Codec.load(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t) for i, t in enumerate(samples(50))] + [(None, "x y"), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("3 AS ids", "text", "doc_id")
    out = encode(df, codec)
    got = out.collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(d), library.encode(t or "")) for d, t in rows)
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in got) and len(got) == len(rows)
    back = {(r.doc_id, r.text) for r in decode(out, codec).collect()}
    assert back == {(d, (t or "").replace(SPACE, " ")) for d, t in rows}
    assert encode(df.limit(0), codec).count() == 0


def test_documents_equal_the_library(spark):
    codec, library = Codec.load(), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: library.encode(r.text) for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.ids for r in encode(docs, codec).collect()} == want
