"""Checksums, digests and ciphers. Digests are lowercase hex; ciphers work on binary columns by Spark's own AES."""

from __future__ import annotations

import hashlib
import hmac as std_hmac
import socket

import numpy as np
import pandas as pd
import xxhash as std_xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 16
#: The first 12 bytes of an IPv4 address in IPv6 form.
MAPPED = "00000000000000000000FFFF"
MASK = (1 << 64) - 1
#: SeaHash's fixed seeds and multiplier.
SEA_SEEDS, SEA_FACTOR = (0x16F11FE89B0D677C, 0xB480A793D8E6C86C, 0x6FE2E5AAF078EBC9, 0x14F994A4C5259381), 0x6EED0E9DA4D94A4F


def crc(c: Column) -> Column:
    """CRC-32 as a decimal string."""
    return F.crc32(c.cast("binary")).cast("string")


@F.pandas_udf(T.LongType())
def xxhash(values: pd.Series) -> pd.Series:
    """XXH64 with seed 0, signed."""
    return values.map(lambda v: None if v is None else (std_xxhash.xxh64_intdigest(v.encode(), 0) ^ (1 << 63)) - (1 << 63)).astype("Int64")


def _sea_mix(x: int) -> int:
    x = x * SEA_FACTOR & MASK
    x ^= (x >> 32) >> (x >> 60)
    return x * SEA_FACTOR & MASK


def _seahash(raw: bytes) -> int:
    lanes = list(SEA_SEEDS)
    for i in range(0, len(raw), 8):
        lanes = [*lanes[1:], _sea_mix(lanes[0] ^ int.from_bytes(raw[i : i + 8], "little"))]
    whole = lanes[0] ^ lanes[1] ^ lanes[2] ^ lanes[3] ^ len(raw)
    return (_sea_mix(whole) ^ (1 << 63)) - (1 << 63)


@F.pandas_udf(T.LongType())
def seahash(values: pd.Series) -> pd.Series:
    """SeaHash, signed."""
    return values.map(lambda v: None if v is None else _seahash(v.encode())).astype("Int64")


def md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def sha1(c: Column) -> Column:
    return F.sha1(c.cast("binary"))


def _hashed(name: str):
    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hashlib.new(name, bytes(v)).hexdigest())

    return digest


def sha2(c: Column, variant: str = "SHA-512/256") -> Column:
    """SHA-224, SHA-256, SHA-384, SHA-512, SHA-512/224, SHA-512/256."""
    bits = variant.removeprefix("SHA-")
    raw = c.cast("binary")
    return _hashed(f"sha512_{bits[4:]}")(raw) if bits.startswith("512/") else F.sha2(raw, int(bits))


def sha3(c: Column, variant: str = "SHA3-512") -> Column:
    return _hashed(f"sha3_{int(variant.removeprefix('SHA3-'))}")(c.cast("binary"))


def hmac(c: Column, key: Column, algorithm: str = "SHA-256") -> Column:
    """Raw bytes; SHA-1, SHA-224, SHA-256, SHA-384, SHA-512 or MD5."""
    name = algorithm.replace("-", "").lower()

    @F.pandas_udf("binary")
    def sign(values: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or k is None else std_hmac.digest(bytes(k), bytes(v), name) for v, k in zip(values, keys)], dtype=object)

    return sign(c.cast("binary"), key.cast("binary"))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def xor(a: Column, b: Column) -> Column:
    """Two binary columns of one length, xored, four bytes at a time."""

    def mixed(a: Column, b: Column) -> Column:
        words = F.sequence(F.lit(0), F.ceil(F.octet_length(a) / 4).cast("int") - 1)
        word = lambda c, i: F.conv(F.hex(F.substring(c, i * 4 + 1, F.lit(4))), 16, 10).cast("bigint")
        width = lambda i: 2 * F.least(F.lit(4), F.octet_length(a) - i * 4)
        each = F.transform(words, lambda i: F.lpad(F.hex(word(a, i).bitwiseXOR(word(b, i))), width(i), F.lit("0")))
        return F.when(F.octet_length(a) == 0, a).otherwise(F.unhex(F.array_join(each, "")))

    return _let(F.struct(a.alias("a"), b.alias("b")), lambda s: mixed(s["a"], s["b"]))


def _aes(block: Column, key: Column) -> Column:
    """One AES block (what Spark adds as padding is cut)."""
    return F.substring(F.aes_encrypt(block, key, F.lit("ECB"), F.lit("PKCS")), 1, BLOCK)


def _aes_back(block: Column, key: Column) -> Column:
    """One block deciphered: Spark wants its padding, which is a block of its own."""
    padding = F.aes_encrypt(F.lit(b""), key, F.lit("ECB"), F.lit("PKCS"))
    return F.aes_decrypt(F.concat(block, padding), key, F.lit("ECB"), F.lit("PKCS"))


def _blocks(c: Column) -> Column:
    return F.when(F.octet_length(c) > 0, F.transform(F.sequence(F.lit(0), ((F.octet_length(c) - 1) / BLOCK).cast("int")), lambda i: F.substring(c, i * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<binary>"))


def _counter(iv: Column, i: Column) -> Column:
    """iv + i as a 128-bit number."""
    limb = lambda k: F.conv(F.hex(F.substring(iv, F.lit(4 * k + 1), F.lit(4))), 16, 10).cast("bigint")
    low = limb(3) + i
    parts, carry = [low.bitwiseAND(F.lit(0xFFFFFFFF))], F.shiftright(low, 32)
    for k in (2, 1, 0):
        word = limb(k) + carry
        parts.insert(0, word.bitwiseAND(F.lit(0xFFFFFFFF)))
        carry = F.shiftright(word, 32)
    return F.unhex(F.concat(*[F.lpad(F.hex(p), 8, "0") for p in parts]))


def _stream(c: Column, mode: str, key: Column, iv: Column, forward: bool) -> Column:
    return _let(_blocks(c), lambda blocks: _stream_of(blocks, mode, key, iv, forward))


def _stream_of(blocks: Column, mode: str, key: Column, iv: Column, forward: bool) -> Column:
    joined = lambda xs: F.unhex(F.array_join(F.transform(xs, lambda x: F.hex(x)), ""))
    mixed = lambda x, pad: xor(x, F.substring(pad, F.lit(1), F.octet_length(x)))
    if mode.startswith("CTR"):
        return joined(F.transform(blocks, lambda x, i: mixed(x, _aes(_counter(iv, i.cast("bigint")), key))))
    empty = F.struct(iv.alias("last"), F.lit(b"").alias("out"))
    if mode == "OFB":
        step = lambda s, x: _let(_aes(s["last"], key), lambda pad: F.struct(pad.alias("last"), F.concat(s["out"], mixed(x, pad)).alias("out")))
        return F.aggregate(blocks, empty, step, lambda s: s["out"])
    if not forward:
        return joined(F.transform(blocks, lambda x, i: mixed(x, _aes(F.when(i == 0, iv).otherwise(F.get(blocks, i - 1)), key))))
    step = lambda s, x: _let(mixed(x, _aes(s["last"], key)), lambda y: F.struct(y.alias("last"), F.concat(s["out"], y).alias("out")))
    return F.aggregate(blocks, empty, step, lambda s: s["out"])


def _cipher(c: Column, algorithm: str, key: Column, iv: Column, forward: bool) -> Column:
    if algorithm.upper() == "CHACHA20-POLY1305":
        return _aead(forward)(c.cast("binary"), key.cast("binary"), iv.cast("binary"))
    name, bits, mode = algorithm.upper().split("-", 2)
    if name != "AES" or int(bits) not in (128, 192, 256) or mode not in ("CFB", "OFB", "CTR", "CTR-BE", "CBC-PKCS7"):
        raise ValueError(f"unknown algorithm {algorithm}")
    key, iv = key.cast("binary"), iv.cast("binary")
    bad = (F.octet_length(key) != int(bits) // 8) | (F.octet_length(iv) != BLOCK)

    def done(raw: Column) -> Column:
        if mode != "CBC-PKCS7":
            return _stream(raw, mode, key, iv, forward)
        args = (key, F.lit("CBC"), F.lit("PKCS"))
        return F.substring(F.aes_encrypt(raw, *args, iv), F.lit(BLOCK + 1), F.octet_length(raw) + BLOCK) if forward else F.aes_decrypt(F.concat(iv, raw), *args)

    return F.when(bad, F.raise_error(F.lit(f"{algorithm}: wrong key or iv length"))).otherwise(_let(c.cast("binary"), done))


def chacha_blocks(key: bytes, nonce: bytes, count: int) -> bytes:
    """The ChaCha20 key stream from block 0 on (RFC 8439), all blocks at once."""
    start = np.empty((16, count), np.uint32)
    start[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    start[4:12], start[12], start[13:] = np.frombuffer(key, "<u4")[:, None], np.arange(count), np.frombuffer(nonce, "<u4")[:, None]
    x = start.copy()
    turn = lambda v, n: (v << np.uint32(n)) | (v >> np.uint32(32 - n))
    for _ in range(10):
        for a, b, c, d in ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)):
            for p, q, r, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
                x[p] += x[q]
                x[r] = turn(x[r] ^ x[p], n)
    return (x + start).T.astype("<u4").tobytes()


def poly1305(key: bytes, message: bytes) -> bytes:
    r, s, total = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF, int.from_bytes(key[16:32], "little"), 0
    for i in range(0, len(message), 16):
        total = (total + int.from_bytes(message[i : i + 16] + b"\x01", "little")) * r % ((1 << 130) - 5)
    return ((total + s) & ((1 << 128) - 1)).to_bytes(16, "little")


def _aead(forward: bool):
    @F.pandas_udf(T.BinaryType())
    def run(values: pd.Series, keys: pd.Series, nonces: pd.Series) -> pd.Series:
        def one(v, key, nonce):
            if v is None or key is None or nonce is None:
                return None
            v, key, nonce = bytes(v), bytes(key), bytes(nonce)
            if len(key) != 32 or len(nonce) != 12:
                raise ValueError("CHACHA20-POLY1305: wrong key or iv length")
            body, tag = (v, b"") if forward else (v[:-16], v[-16:])
            stream = chacha_blocks(key, nonce, 1 + -(-len(body) // 64))
            mixed = (np.frombuffer(body, np.uint8) ^ np.frombuffer(stream, np.uint8)[64 : 64 + len(body)]).tobytes()
            sealed = mixed if forward else body
            own = poly1305(stream[:32], sealed + bytes(-len(sealed) % 16) + (0).to_bytes(8, "little") + len(sealed).to_bytes(8, "little"))
            if not forward and not std_hmac.compare_digest(own, tag):
                raise ValueError("CHACHA20-POLY1305: the tag doesn't match")
            return mixed + own if forward else mixed

        return pd.Series([one(*r) for r in zip(values, keys, nonces)], dtype=object)

    return run


def encrypt(c: Column, algorithm: str, key: Column, iv: Column) -> Column:
    """AES-128, -192 or -256 with CFB, OFB, CTR, CTR-BE or CBC-PKCS7, or CHACHA20-POLY1305 (its tag is appended); binary out."""
    return _cipher(c, algorithm, key, iv, True)


def decrypt(c: Column, algorithm: str, key: Column, iv: Column) -> Column:
    return _cipher(c, algorithm, key, iv, False)


def community_id(source_ip: Column, destination_ip: Column, protocol: Column, source_port: Column, destination_port: Column, seed: int = 0) -> Column:
    """Version 1 flow id; null where an address is bad or TCP, UDP or SCTP lack ports."""

    @F.pandas_udf("string")
    def flow(a: pd.Series, b: pd.Series, proto: pd.Series, pa: pd.Series, pb: pd.Series) -> pd.Series:
        import base64

        def packed(ip):
            return socket.inet_pton(socket.AF_INET6 if ":" in ip else socket.AF_INET, ip)

        def one(x, y, p, m, n):
            has = m == m and n == n and m is not None and n is not None
            if x is None or y is None or p != p or not has and int(p) in (6, 17, 132):
                return None
            try:
                ends = sorted([(packed(x), int(m) if has else 0), (packed(y), int(n) if has else 0)])
            except OSError:
                return None
            body = seed.to_bytes(2, "big") + ends[0][0] + ends[1][0] + bytes([int(p), 0])
            body += b"".join(e[1].to_bytes(2, "big") for e in ends) if has else b""
            return "1:" + base64.b64encode(hashlib.sha1(body).digest()).decode()

        return pd.Series([one(*r) for r in zip(a, b, proto, pa, pb)], dtype=object)

    return flow(source_ip, destination_ip, protocol, source_port, destination_port)


def _address(c: Column) -> Column:
    from .ip import ip_pton

    return _let(ip_pton(c), lambda raw: F.when(F.octet_length(raw) == 4, F.concat(F.unhex(F.lit(MAPPED)), raw)).otherwise(raw))


def _is_mapped(raw: Column) -> Column:
    return F.hex(F.substring(raw, 1, 12)) == MAPPED


def _shown(c: Column) -> Column:
    from .ip import ip_ntop

    return ip_ntop(_let(c, lambda raw: F.when(_is_mapped(raw), F.substring(raw, 13, 4)).otherwise(raw)))


def encrypt_ip(c: Column, key: Column) -> Column:
    """One AES block over the address, as IPv6 text; the key has 16 bytes."""
    return _shown(_aes(_address(c), key.cast("binary")))


def decrypt_ip(c: Column, key: Column) -> Column:
    return _shown(_aes_back(_address(c), key.cast("binary")))
