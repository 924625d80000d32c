"""Golden frames and a byte-at-a-time walk to check against."""

HR_REQUEST = "01 03 00 00 00 1C 44 03"
HR_RESPONSE = (
    "01 03 38 00 65 FF FF FF FF FF FF FF FF 53 4E 30 30 30 30 30 30 30 31 FF FF 00 BA 00 30 0B CE 00 00 00 00 00 00 "
    "11 4B 38 9D 00 CF 00 00 00 5F 14 BF FF F2 00 11 23 28 20 B2 20 B2 91 DD"
)
IR1_REQUEST = "01 04 00 00 00 15 31 C5"
IR1_RESPONSE = (
    "01 04 00 00 53 4E 30 30 30 30 30 30 30 31 20 20 20 20 20 20 20 20 20 20 00 00 00 AB 00 B2 00 AD 00 A5 00 A9 "
    "00 01 00 08 00 00 00 00 00 00 4A BB"
)
IR2_REQUEST = "01 04 00 15 00 13 A0 03"
IR2_RESPONSE = (
    "01 04 00 15 10 02 E1 00 00 CD 33 CF 85 FF FF FF 35 00 00 4B C0 00 00 48 A8 00 00 46 7B 5D 00 00 0E 10 00 00 00 "
    "00 00 0B CE 00 7C 51"
)
IR3_REQUEST = "01 04 00 28 00 14 70 0D"
IR3_RESPONSE = (
    "01 04 00 28 0C F4 0C F5 0C F5 0C F7 0C F7 0C F7 0C F7 0C F8 0C F8 0C F8 0C FA 0C FA 0C FA 0C FA 0C FA 0C FC "
    "00 B3 00 A5 0C FC 0C F4 A3 11"
)
ABSENT_IR1 = "03 04 00 00 " + "00 " * 22 + "F5 56 " * 5 + "00 " * 10 + "38 17"
EXCEPTION = "01 83 01 80 F0"
WRITE = "01 06 00 E7 00 01 F8 3D"

GOLDEN = [
    HR_REQUEST, HR_RESPONSE, IR1_REQUEST, IR1_RESPONSE, IR2_REQUEST, IR2_RESPONSE, IR3_REQUEST, IR3_RESPONSE,
    WRITE, WRITE, HR_REQUEST, EXCEPTION,
]


def raw(text: str) -> bytes:
    return bytes.fromhex(text)


def crc(data: bytes) -> bytes:
    reg = 0xFFFF
    for byte in data:
        reg ^= byte
        for _ in range(8):
            reg = (reg >> 1) ^ 0xA001 if reg & 1 else reg >> 1
    return bytes([reg & 255, reg >> 8])


def plain_walk(buf: bytes) -> tuple[list[tuple], int]:
    """Frames ``(off, len, role, swap)`` and dropped bytes, decided one by one."""
    out, drops, at, role, count = [], 0, 0, 0, None
    while at < len(buf) - 3:
        fc = buf[at + 1]
        sizes = (
            8 if fc in (3, 4, 6) else 0,
            {3: 5 + buf[at + 2], 4: 0 if count is None else 6 + 2 * count, 6: 8}.get(fc, 5 if fc & 128 else 0),
        )
        for side in (role, 1 - role):
            n = sizes[side]
            if n and at + n <= len(buf) and crc(buf[at : at + n - 2]) == buf[at + n - 2 : at + n]:
                out.append((at, n, ("request", "response")[side], side != role))
                count = int.from_bytes(buf[at + 4 : at + 6], "big") if side == 0 and fc in (3, 4) else None
                role, at = 1 - side, at + n
                break
        else:
            drops, at = drops + 1, at + 1
    return out, drops


def noisy_traffic(rnd, exchanges: int, errors: float) -> bytes:
    body = bytearray()
    for _ in range(exchanges):
        device, pick = rnd.randint(1, 5), rnd.random()
        if pick < 0.5:
            ask, answer = bytes([device, 3, 0, 0, 0, 28]), bytes([device, 3, 56]) + rnd.randbytes(56)
        elif pick < 0.9:
            n = rnd.choice([19, 20, 21])
            ask, answer = bytes([device, 4, 0, 0, 0, n]), bytes([device, 4, 0, 0]) + rnd.randbytes(2 * n)
        elif pick < 0.95:
            ask = answer = bytes([device, 6, 0, 1, 0, 2])
        else:
            ask, answer = bytes([device, 3, 0, 0, 0, 28]), bytes([device, 0x83, 2])
        for part in (ask, answer):
            if rnd.random() >= errors:
                body += part + crc(part)
    out = bytearray()
    for byte in body:
        luck = rnd.random()
        if luck < errors / 3:
            continue
        if luck < 2 * errors / 3:
            byte ^= rnd.randint(1, 255)
        elif luck < errors:
            out.append(rnd.randint(0, 255))
        out.append(byte)
    return bytes(out)
