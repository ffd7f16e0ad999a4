"""RC4, AES-CBC, document keys and password checks of the standard security handler (revisions 2 to 6)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codecs import on_bytes


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    i = j = 0
    out = bytearray()
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def _double(x: int) -> int:
    return (x << 1) ^ (0x11B if x & 0x80 else 0)


def _times(x: int, y: int) -> int:
    out = 0
    while y:
        out ^= x if y & 1 else 0
        x, y = _double(x), y >> 1
    return out


def _substitution() -> list[int]:
    """The AES substitution by its rule: the inverse in the field, then the affine map."""
    power, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= _double(x)
    out = []
    for v in range(256):
        inv = power[-log[v] % 255] if v else 0
        out.append(inv ^ 0x63)
        for k in range(1, 5):
            out[-1] ^= (inv << k | inv >> (8 - k)) & 255
    return out


_S = _substitution()
_INV = [_S.index(i) for i in range(256)]
_MUL = {m: [_times(i, m) for i in range(256)] for m in (2, 3, 9, 11, 13, 14)}


def _round_keys(key: bytes) -> list[bytes]:
    n = len(key) // 4
    words, rcon = [key[4 * i : 4 * i + 4] for i in range(n)], 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes(_S[b] for b in w[1:] + w[:1])
            w = bytes((w[0] ^ rcon,)) + w[1:]
            rcon = _double(rcon)
        elif n > 6 and i % n == 4:
            w = bytes(_S[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], w, strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


_SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]
_UNSHIFT = [(i - 4 * (i % 4)) % 16 for i in range(16)]


def _xor(a: bytes, b: bytes) -> bytes:
    return bytes(x ^ y for x, y in zip(a, b, strict=True))


def _encrypt_block(keys: list[bytes], block: bytes) -> bytes:
    s = _xor(block, keys[0])
    two, three = _MUL[2], _MUL[3]
    for k in keys[1:-1]:
        t = [_S[s[i]] for i in _SHIFT]
        mixed = []
        for c in range(0, 16, 4):
            a, b, d, e = t[c : c + 4]
            mixed += (two[a] ^ three[b] ^ d ^ e, a ^ two[b] ^ three[d] ^ e, a ^ b ^ two[d] ^ three[e], three[a] ^ b ^ d ^ two[e])
        s = _xor(bytes(mixed), k)
    return _xor(bytes(_S[s[i]] for i in _SHIFT), keys[-1])


def _decrypt_block(keys: list[bytes], block: bytes) -> bytes:
    s = _xor(block, keys[-1])
    nine, eleven, thirteen, fourteen = (_MUL[m] for m in (9, 11, 13, 14))
    for k in keys[-2:0:-1]:
        t = _xor(bytes(_INV[s[i]] for i in _UNSHIFT), k)
        mixed = []
        for c in range(0, 16, 4):
            a, b, d, e = t[c : c + 4]
            mixed += (
                fourteen[a] ^ eleven[b] ^ thirteen[d] ^ nine[e], nine[a] ^ fourteen[b] ^ eleven[d] ^ thirteen[e],
                thirteen[a] ^ nine[b] ^ fourteen[d] ^ eleven[e], eleven[a] ^ thirteen[b] ^ nine[d] ^ fourteen[e],
            )
        s = bytes(mixed)
    return _xor(bytes(_INV[s[i]] for i in _UNSHIFT), keys[0])


def aes_cbc_encrypt(key: bytes, iv: bytes, data: bytes, pad: bool = True) -> bytes:
    if pad:
        n = 16 - len(data) % 16
        data += bytes((n,)) * n
    elif len(data) % 16:
        raise ValueError("without padding the data must fill whole blocks")
    keys, out = _round_keys(key), []
    for at in range(0, len(data), 16):
        iv = _encrypt_block(keys, _xor(data[at : at + 16], iv))
        out.append(iv)
    return b"".join(out)


def aes_cbc_decrypt(key: bytes, iv: bytes, data: bytes, pad: bool = True) -> bytes:
    if len(data) % 16:
        raise ValueError("the data must fill whole blocks")
    keys, out = _round_keys(key), []
    for at in range(0, len(data), 16):
        block = data[at : at + 16]
        out.append(_xor(_decrypt_block(keys, block), iv))
        iv = block
    plain = b"".join(out)
    if not pad or not plain:
        return plain
    if not 1 <= plain[-1] <= 16 or plain[-plain[-1] :] != plain[-1:] * plain[-1]:
        raise ValueError("the padding is wrong")
    return plain[: -plain[-1]]


def object_key(key: bytes, obj: int, gen: int, aes: bool) -> bytes:
    raw = key + obj.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + (b"sAlT" if aes else b"")
    return hashlib.md5(raw).digest()[: min(len(key) + 5, 16)]


def object_key_column(key: Column, obj: Column, gen: Column, aes: bool, n: int) -> Column:
    """The same in column expressions; ``n``: bytes of the file key."""
    swap = lambda c, k: F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(c, 8 * i).bitwiseAND(F.lit(255))), 2, "0")) for i in range(k)))
    parts = [key, swap(obj, 3), swap(gen, 2)] + ([F.lit(b"sAlT")] if aes else [])
    return F.substring(F.unhex(F.md5(F.concat(*parts))), 1, min(n + 5, 16))


def crypt(method: str, key: bytes, obj: int, gen: int, data: bytes, iv: bytes | None = None) -> bytes:
    """Decrypts (without ``iv``) or encrypts a string or stream by V2 (either way alike), AESV2 or AESV3."""
    if method == "Identity":
        return data
    if method == "V2":
        return rc4(object_key(key, obj, gen, False), data)
    mine = key if method == "AESV3" else object_key(key, obj, gen, True)
    if iv is not None:
        return iv + aes_cbc_encrypt(mine, iv, data)
    return aes_cbc_decrypt(mine, data[:16], data[16:]) if len(data) >= 32 else b""


#: Fixed value: the padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def pad_password(password: bytes) -> bytes:
    return (password + PAD)[:32]


def file_key(password: bytes, o: bytes, p: int, file_id: bytes, r: int, n: int, encrypt_metadata: bool = True) -> bytes:
    """The key of revisions 2 to 4; ``n`` in bytes."""
    h = hashlib.md5(pad_password(password) + o + (p & 0xFFFFFFFF).to_bytes(4, "little") + file_id + (b"\xff\xff\xff\xff" if r >= 4 and not encrypt_metadata else b"")).digest()
    if r >= 3:
        for _ in range(50):
            h = hashlib.md5(h[:n]).digest()
    return h[:n]


def owner_entry(owner: bytes, user: bytes, r: int, n: int) -> bytes:
    h = hashlib.md5(pad_password(owner or user)).digest()
    for _ in range(50 if r >= 3 else 0):
        h = hashlib.md5(h).digest()
    out = pad_password(user)
    for i in range(20 if r >= 3 else 1):
        out = rc4(bytes(b ^ i for b in h[:n]), out)
    return out


def user_entry(key: bytes, file_id: bytes, r: int) -> bytes:
    if r == 2:
        return rc4(key, PAD)
    out = hashlib.md5(PAD + file_id).digest()
    for i in range(20):
        out = rc4(bytes(b ^ i for b in key), out)
    return out + bytes(16)


def hardened_hash(password: bytes, salt: bytes, extra: bytes, r: int) -> bytes:
    """The hash of revisions 5 and 6."""
    k = hashlib.sha256(password + salt + extra).digest()
    if r < 6:
        return k
    i = 0
    while True:
        e = aes_cbc_encrypt(k[:16], k[16:32], (password + k + extra) * 64, pad=False)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


def authenticate(entries: dict, password: bytes, file_id: bytes = b"") -> tuple[str, bytes] | None:
    """("user" or "owner", file key), or None. ``entries``: R, Length (bits), P, O, U, OE, UE, EncryptMetadata."""
    r, o, u = entries["R"], entries["O"], entries["U"]
    if r >= 5:
        password = password[:127]
        for who, entry, extra, wrapped in (("owner", o, u[:48], entries.get("OE")), ("user", u, b"", entries.get("UE"))):
            if hardened_hash(password, entry[32:40], extra, r) == entry[:32]:
                return who, aes_cbc_decrypt(hardened_hash(password, entry[40:48], extra, r), bytes(16), wrapped[:32], pad=False)
        return None
    n = 5 if r == 2 else entries.get("Length", 40) // 8
    meta = entries.get("EncryptMetadata", True)
    key = file_key(password, o, entries["P"], file_id, r, n, meta)
    same = 32 if r == 2 else 16
    if user_entry(key, file_id, r)[:same] == u[:same]:
        return "user", key
    h = hashlib.md5(pad_password(password)).digest()
    for _ in range(50 if r >= 3 else 0):
        h = hashlib.md5(h).digest()
    plain = o
    for i in range(19 if r >= 3 else 0, -1, -1):
        plain = rc4(bytes(b ^ i for b in h[:n]), plain)
    key = file_key(plain, o, entries["P"], file_id, r, n, meta)
    return ("owner", key) if user_entry(key, file_id, r)[:same] == u[:same] else None


def encrypt_entries(user: bytes, owner: bytes, r: int, bits: int, p: int, file_id: bytes, salt: bytes = bytes(32), key: bytes = bytes(32)) -> dict:
    """The entries of an encryption dictionary; ``salt`` (32 bytes) and ``key`` serve revisions 5 and 6."""
    if r < 5:
        n = 5 if r == 2 else bits // 8
        o = owner_entry(owner, user, r, n)
        return {"R": r, "Length": bits, "P": p, "O": o, "U": user_entry(file_key(user, o, p, file_id, r, n), file_id, r)}
    u = hardened_hash(user, salt[:8], b"", r) + salt[:16]
    o = hardened_hash(owner, salt[16:24], u, r) + salt[16:32]
    out = {"R": r, "Length": 256, "P": p, "U": u, "O": o}
    out["UE"] = aes_cbc_encrypt(hardened_hash(user, salt[8:16], b"", r), bytes(16), key, pad=False)
    out["OE"] = aes_cbc_encrypt(hardened_hash(owner, salt[24:32], u, r), bytes(16), key, pad=False)
    perms = (p & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff\xff\xff\xffTadb" + salt[:4]
    out["Perms"] = aes_cbc_encrypt(key, bytes(16), perms, pad=False)
    return out


def rc4_column(key: Column, data: Column) -> Column:
    return on_bytes(rc4, key, data)


def aes_encrypt_nopad(key: Column, iv: Column, data: Column) -> Column:
    return on_bytes(lambda k, i, x: aes_cbc_encrypt(k, i, x, pad=False), key, iv, data)


def aes_decrypt_nopad(key: Column, iv: Column, data: Column) -> Column:
    return on_bytes(lambda k, i, x: aes_cbc_decrypt(k, i, x, pad=False), key, iv, data)


def aes_encrypt(key: Column, iv: Column, data: Column) -> Column:
    """With padding, by Spark's own function, which puts the IV first."""
    return F.substring(F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv), 17, 2**31 - 1)


def aes_decrypt(key: Column, iv: Column, data: Column) -> Column:
    return F.aes_decrypt(F.concat(iv, data), key, F.lit("CBC"), F.lit("PKCS"))
