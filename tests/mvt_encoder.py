"""Encoder of vector tiles for tests, the inverse of the decoder."""

import struct


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


def zigzag(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def value(v):
    if isinstance(v, bool):
        return varint(7 << 3) + varint(v)
    if isinstance(v, int):
        return varint(4 << 3) + varint(v)
    if isinstance(v, float):
        return varint(3 << 3 | 1) + struct.pack("<d", v)
    return field(1, v.encode())


def geometry(parts, kind):
    out, x, y = [], 0, 0
    for part in parts:
        for i, (px, py) in enumerate(part):
            if i < 2:
                out.append((1 if i == 0 else 2) | (1 if i == 0 else len(part) - 1) << 3)
            out += [zigzag(px - x), zigzag(py - y)]
            x, y = px, py
        if kind == 3:
            out.append(7 | 1 << 3)
    return b"".join(map(varint, out))


def tile(layers):
    """layers: (name, extent, features); a feature is (id, kind, props, parts)."""
    out = b""
    for name, extent, features in layers:
        keys, values, body = [], [], field(1, name.encode())
        for fid, kind, props, parts in features:
            tags = b""
            for k, v in props.items():
                if k not in keys:
                    keys.append(k)
                at = next((i for i, x in enumerate(values) if type(x) is type(v) and x == v), len(values))
                if at == len(values):
                    values.append(v)
                tags += varint(keys.index(k)) + varint(at)
            body += field(2, varint(1 << 3) + varint(fid) + field(2, tags) + varint(3 << 3) + varint(kind) + field(4, geometry(parts, kind)))
        body += b"".join(field(3, k.encode()) for k in keys) + b"".join(field(4, value(v)) for v in values) + varint(5 << 3) + varint(extent) + varint(15 << 3) + varint(2)
        out += field(3, body)
    return out
