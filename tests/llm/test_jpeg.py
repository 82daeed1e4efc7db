import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from rowcloak.llm import jpeg
from rowcloak.llm.jpeg import decode_many, encode_many, feature_of, inverse_basis, padded, payload_of, read_media, rgb, store_media


def payloads():
    rng = random.Random(2)
    out = [padded(b""), padded(b"x"), padded("é‑中文".encode() * 300), bytes(range(256)) * 9, b"\x80" * 576, b"\x7f\x80\x81" * 192 * 4,
           bytes(rng.choice([127, 128, 129, 128, 128]) for _ in range(5760)), bytes([128] * 500 + [129] + [128] * 75), bytes(rng.randrange(256) for _ in range(20_736)), b"\xff" * 1152]
    return out


def test_round_trip():
    files = encode_many(payloads())
    assert [payload_of(f) for f in decode_many(files)] == payloads()
    assert [encode_many([p])[0] for p in payloads()] == files  # the batch doesn't matter


def test_many_rows_of_mcus(monkeypatch):
    monkeypatch.setattr(jpeg, "MOST_ACROSS", 5)
    p = payloads()
    assert [payload_of(f) for f in decode_many(encode_many(p))] == p


class Slow:
    """A plain sequential decoder of one file, to hold the batch decoder against."""

    def __init__(self, data):
        self.frame = f = jpeg.Frame(data)
        jpeg.pool_coefficients([f])
        for pick, lo, hi, high, low, interval, tables, buf in f.scans:
            order = f.order(pick)
            self.segs = self.split(buf.tobytes())
            codes = [self.codes(t) for t in tables]
            names = [i for i, _ in pick]
            n = len(order[0][1])
            for m in range(n):
                if m % (interval or n) == 0:
                    self.bitsleft = "".join(f"{b:08b}" for b in self.segs.pop(0))
                    pred, self.eob = dict.fromkeys(names, 0), 0
                for i, blocks in order:
                    c = f.coef[i][blocks[m]]
                    table = codes[names.index(i)]
                    if lo == 0 and high == 0:
                        pred[i] += self.extend(self.symbol(table))
                        c[0] = pred[i] << low
                    elif lo == 0:
                        c[0] |= self.take(1) << low
                    elif high == 0:
                        self.first(c, table, lo, hi, low)
                    else:
                        self.refine(c, table, lo, hi, low)

    @staticmethod
    def split(b):
        out, cur, i = [], bytearray(), 0
        while i < len(b):
            if b[i] == 255 and b[i + 1] != 0:
                out.append(bytes(cur))
                cur, i = bytearray(), i + 2
                continue
            cur.append(b[i])
            i += 2 if b[i] == 255 else 1
        return [*out, bytes(cur)]

    @staticmethod
    def codes(t):
        out, code, k = {}, 0, 0
        for n in range(1, 17):
            for _ in range(t[0][n - 1] if t[0] else 0):
                out[f"{code:0{n}b}"] = t[1][k]
                code, k = code + 1, k + 1
            code <<= 1
        return out

    def take(self, n):
        v, self.bitsleft = self.bitsleft[:n], self.bitsleft[n:]
        return int(v, 2) if n else 0

    def symbol(self, table):
        for n in range(1, 17):
            if self.bitsleft[:n] in table:
                s, self.bitsleft = table[self.bitsleft[:n]], self.bitsleft[n:]
                return s
        raise ValueError

    def extend(self, n):
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def first(self, c, table, lo, hi, low):
        k = lo
        if self.eob:
            self.eob -= 1
            return
        while k <= hi:
            r, s = divmod(self.symbol(table), 16)
            if s:
                k += r
                c[k] = self.extend(s) << low
            elif r < 15:
                self.eob = (1 << r) + self.take(r) - 1
                return
            else:
                k += 15
            k += 1

    def refine(self, c, table, lo, hi, low):
        k = lo

        def fix(k):
            if self.take(1):
                c[k] += (1 if c[k] > 0 else -1) << low

        while k <= hi and not self.eob:
            r, s = divmod(self.symbol(table), 16)
            v = (1 if self.take(1) else -1) << low if s else 0
            if not s and r < 15:
                self.eob = (1 << r) + self.take(r)
                break
            while k <= hi:
                if c[k]:
                    fix(k)
                elif r:
                    r -= 1
                else:
                    if s:
                        c[k] = v
                    k += 1
                    break
                k += 1
        if self.eob:
            for j in range(k, hi + 1):
                if c[j]:
                    fix(j)
            self.eob -= 1


def test_against_a_sequential_decoder():
    files = encode_many(payloads())
    for f, data in zip(decode_many(files), files):
        for a, b in zip(f.coef, Slow(data).frame.coef):
            assert (a == b).all()


def test_transform_and_colour():
    basis = inverse_basis()
    assert np.allclose(basis @ basis.T, np.eye(64))
    f = decode_many(encode_many([bytes([128] * 768)]))[0]
    assert (rgb(f) == 128).all() and rgb(f).shape == (16, 32, 3)
    f.coef[0][0, 0], f.coef[2][0, 0] = 80, 160  # luma of one block +10, red difference of four blocks +20
    x = rgb(f)
    assert x[0, 0].tolist() == [166, 124, 138] and x[0, 8].tolist() == [156, 114, 128] and x[15, 15].tolist() == [156, 114, 128]
    assert feature_of(np.full((2, 2, 3), 7, np.uint8)) == "2x2 mean 7.000 7.000 7.000 sd 0.000 0.000 0.000"


def test_query(spark):
    from rowcloak.llm.queries import op6_jpeg

    docs = {d.doc_id: (d.text or "").encode() for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op6_jpeg(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        p = padded(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    df = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "", 1), (3, "a" * 3_000_000, 2)], "doc_id long, text string, _media int")
    got = read_media(store_media(df)).collect()
    assert [len(r._payload) for r in got] == [576, 576, 576, 3_000_384] and got[0]._media == got[2]._media
    assert all(len(r._tensor) == 3 * r._height * r._width for r in got)
    assert read_media(store_media(df.limit(0))).count() == 0
