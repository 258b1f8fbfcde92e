"""Digests, spans and formats against brute force, with nulls, empty and long texts, ties and clashing columns."""

import hashlib
import random
import re
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, chat, media, pii

DOCS = "doc_id long, text string, media string, row_key string, f0 string"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "x", "y", "z") for i, t in enumerate(texts)], DOCS)


TEXTS = [None, "", " ", "a", "The same text, twice.", "The same text, twice.", "É 漢字 😀 don't  stop\n\n\n  now 12345", "</s>[INST]" * 3, "ab" * 40_000, "word " * 30_000]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_equals_the_library(spark):
    import public_tokenizers
    import tiktoken

    codec = bpe.load_codec(None, None)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = by_id(bpe.encode_documents(docs(spark, TEXTS)))
    for i, t in enumerate(TEXTS):
        ids = own.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(docs(spark, TEXTS).limit(0)).collect() == []


def test_bpe_on_random_text():
    import numpy as np
    import public_tokenizers
    import tiktoken

    codec = bpe.load_codec(None, None)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = list("ab1.,'sté漢😀 \n\t\x85\u2028\u3000\x1c") + ["'ll", "a" * 50, "  ", "aaab"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(800)]
    for t, ids in zip(texts, codec.encode_batch(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == own.encode_ordinary(t), t


PII = [
    *TEXTS[:4],
    "mail a.b+c@d-e.co.uk! x@y.z, p@q and @r.s a@b.c_d@e.f",
    "ip 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 007.08.0.00 1.2.3",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 then 4465758382889437 4465758382889437 0 12",
    "phone +1 (663) 555-6869 x +49 30 1234567. +1234 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
    "é😀 x@y.zz 漢 1.1.1.1 " * 200,
    "1" * 60_000,
    "1 " * 30_000,
    "a" * 60_000 + "@" + "b." * 20_000 + "c",
    "GB82 WEST 1234 5698 7654 32 bank account GB82 WEST 1234 5698 7654 33 ssn 123-45-6789 and 123-45-6780",
]


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    luhn = lambda d: sum(x - 9 if x > 9 else x for x in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d)))) % 10 == 0
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m)]


def test_pii_spans(spark):
    skip = {11}  # re is quadratic there; the result is known
    got = by_id(pii.find_pii(docs(spark, PII)))
    for i, t in enumerate(PII):
        found = [tuple(s)[:3] for s in got[i].pii_spans]
        if i in skip:
            assert found == [("email", 0, len(t))]
            continue
        want = base_spans(t or "")
        assert [s for s in found if s[0] not in ("iban", "ssn")] == want, i
    assert {s.kind for s in got[12].pii_spans} == {"iban", "ssn"}
    assert sum(s.kind == "iban" for s in got[12].pii_spans) == 1 and sum(s.kind == "ssn" for s in got[12].pii_spans) >= 1


def test_many_matches_in_one_text(spark):
    text = "mail a@b.co card 4111 1111 1111 1111, é 1.2.3.4 " * 20_000
    began = time.time()
    row = pii.find_pii(docs(spark, [text])).first()
    assert time.time() - began < 60
    assert [tuple(s)[:3] for s in row.pii_spans] == base_spans(text)


def test_account_numbers_before_other_words(spark):
    number = "GB82 WEST 1234 5698 7654 32"
    texts = [f"account {number} Bank of X", f"account {number} BANK", f"{number} iban", "iban BE68 5390 0754 7034 ABCD then", f"bank {number} {number}", "account GB82WEST12345698765432 Now", f"bank {number[:-1]}3 X"]
    got = by_id(pii.find_pii(docs(spark, texts)))
    shown = [[t[s.start : s.end] for s in got[i].pii_iban] for i, t in enumerate(texts)]
    assert shown == [[number], [number], [number], ["BE68 5390 0754 7034"], [number, number], ["GB82WEST12345698765432"], []]
    assert by_id(pii.redact_pii(docs(spark, texts)))[3].text == "iban <IBAN> ABCD then"
    assert pii.find_pii(docs(spark, texts).limit(0)).collect() == [] == pii.redact_pii(docs(spark, texts).limit(0)).collect()


def test_redaction_leaves_nothing(spark):
    rows = docs(spark, PII).withColumn("n_chars", F.col("doc_id"))
    out = pii.redact_pii(rows)
    assert out.schema.names == rows.schema.names and out.count() == len(PII)
    got = by_id(out)
    assert got[0].text is None and got[3].text == "a"
    assert "<EMAIL>" in got[4].text and "<CARD>" in got[6].text and "<PHONE>" in got[7].text
    assert all(not base_spans(r.text or "") for r in got.values() if r.doc_id not in (9, 10, 11))
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)


def test_media_round_trip(spark):
    got = by_id(media.media_features(media.store_texts(docs(spark, TEXTS))))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert (got[4].media_sha256, got[4].feature) == (got[5].media_sha256, got[5].feature)


def test_sniffing(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", bytes(13)), (b"IEND", b"")))
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    gif = b"GIF89a" + bytes(7) + b";"
    broken = png[:-1] + b"\0"
    values = [png, b"text" + png + b"more" + gzip.compress(b"hello") + b"x", media.as_wav(b"abc"), z.getvalue(), gif, broken, b"BM and RIFF and %PDF- in a text", None, b""]
    rows = spark.createDataFrame([(i, v, "image/jpeg") for i, v in enumerate(values)], "doc_id long, media binary, declared_type string")
    got = by_id(media.sniff_column(rows))
    assert [got[i].detected_type for i in range(9)] == ["image/png", "image/jpeg", "audio/wav", "application/zip", "image/gif", "image/jpeg", "image/jpeg", "image/jpeg", "image/jpeg"]
    assert [(c.type, c.offset) for c in got[1].carved] == [("image/png", 4), ("application/gzip", 8 + len(png))] and bytes(got[1].carved[0].content) == png
    assert got[0].corrected and not got[5].corrected and got[6].carved == []


def test_values_full_of_magic_bytes():
    """What makes each hit look on to the end of a value costs little, and true media are still found."""
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    pdf, jpeg = b"%PDF-1.4 startxref 9 %%EOF", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02data\xff\xd9"
    began = time.time()
    for junk, real, kind in ((b"%PDF-1 ", pdf, "application/pdf"), (b"PK\x03\x04 ", z.getvalue(), "application/zip"), (b"\x1f\x8b\x08 ", gzip.compress(b"x"), "application/gzip"), (b"\xff\xd8\xff\xe0\x00\x05abc", jpeg, "image/jpeg"), (b"GIF89a" + bytes(7) + b"!", b"GIF89a" + bytes(7) + b";", "image/gif")):
        value = b"text" + junk * 60_000 + b"##" + real
        assert (kind, len(value) - len(real), len(real)) in media.sniff(value), kind
    assert time.time() - began < 30
    assert media.sniff(b"") == [] and media.sniff(gzip.compress(gzip.compress(b"x" * 99)))[0][1] == 0


def test_windows_of_a_value_meet(monkeypatch):
    value = b"0123456" + media.as_wav(b"abc") + b"\x89PNG" + media.as_wav(b"xy")
    whole = media.sniff(value)
    assert [f[1] for f in whole] == [7, len(value) - len(media.as_wav(b"xy"))]
    for window in (1, 3, 8, 11):
        monkeypatch.setattr(media, "WINDOW", window)
        assert media.sniff(value) == whole


def test_media_of_no_rows(spark):
    assert media.media_features(media.store_texts(docs(spark, TEXTS).limit(0))).collect() == []


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_reads_back(spark):
    rng = random.Random(1)
    pieces = chat.TEMPLATE.controls() + list("\\<[/]s>ab\n") + ["\\\\", "[/", "😀"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", "", None, "[INST]"]), rng.choice([None, "", "".join(rng.choices(pieces, k=rng.randint(1, 9)))])) for c in range(60) for t in range(rng.randint(1, 8))]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(6000)] + [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, None, "user", "first")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(conversations(spark, rows))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest()), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    assert got[1000].valid and not got[7].valid
    assert chat.format_conversations(conversations(spark, rows).limit(0)).collect() == []


def test_chat_with_long_texts_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(chat, "BATCH_CHARS", 1000)
    long = "[INST]" + "é" * 300_000
    rows = [(1, 0, "user", long, 5, True), (1, 1, "assistant", long, 6, False), (None, 0, "user", "x", 7, None), (2, 0, "user", "q", 8, None), (2, 1, "assistant", None, 9, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq long, loss boolean")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert set(got) == {1, 2, None} and got[1].valid and got[1].loss_chars == len(long) and got[2].loss_chars == 0
    assert got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_chat_order_of_roles(spark):
    valid = lambda *roles: chat.read_back(chat.format_conversations(conversations(spark, [(1, i, r, "x") for i, r in enumerate(roles)]))).first().valid
    assert valid("system", "user", "assistant") and valid("user", "assistant", "user", "assistant")
    assert not valid("assistant") and not valid("user", "user", "assistant") and not valid("user", "assistant", "system") and not valid("user")


def test_templates_are_checked():
    with pytest.raises(ValueError):
        chat.Template(roles={}, other=("<a", "a>", "<b>"), begin="<", end="</s>", machine={}).check()
