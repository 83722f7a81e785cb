import struct

import pytest

from packetlens.functions import frames, sanitize
from packetlens.operators import captures

CLIENT, SERVER = (b"\x0a\x00\x00\x05", 50_000), (b"\xc6\x12\x00\x07", 443)


def tcp(src, dst, seq, ack, flags, payload=b"", *, vlan=False, fragment=0, v6=False):
    head = struct.pack("!HHIIBBHHH", src[1], dst[1], seq % 2**32, ack % 2**32, 5 << 4, flags, 1000, 0, 0) + payload
    if v6:
        ip = struct.pack("!IHBB", 6 << 28, len(head), 6, 64) + src[0].rjust(16, b"\1") + dst[0].rjust(16, b"\1")
        kind = 0x86DD
    else:
        ip = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(head), 0, fragment, 64, 6, 0) + src[0] + dst[0]
        kind = 0x0800
    tag = struct.pack("!HH", 0x8100, 7) if vlan else b""
    return b"\xaa" * 6 + b"\xbb" * 6 + tag + struct.pack("!H", kind) + ip + head


def pcap(items, *, order="<", nano=False, link=1):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHIIII", magic, 2, 4, 0, 0, 65535, link)
    for us, frame in items:
        part = us % 1_000_000 * (1000 if nano else 1)
        out += struct.pack(order + "IIII", us // 1_000_000, part, len(frame), len(frame)) + frame
    return out


def hello(*names):
    entries = b"".join(struct.pack("!BH", 0, len(n)) + n for n in names)
    listed = struct.pack("!H", len(entries)) + entries
    ext = struct.pack("!HH", 0, len(listed)) + listed
    body = b"\x03\x03" + b"r" * 32 + b"\0" + struct.pack("!H", 2) + b"\x13\x01" + b"\1\0" + struct.pack("!H", len(ext)) + ext
    message = b"\1" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack("!H", len(message)) + message


def session():
    h = hello(b"Host.Example.")
    return [
        (10, tcp(CLIENT, SERVER, 100, 0, 2)), (20, tcp(SERVER, CLIENT, 900, 101, 18)), (30, tcp(CLIENT, SERVER, 101, 901, 16)),
        (40, tcp(CLIENT, SERVER, 101 + 40, 901, 24, h[40:])), (50, tcp(CLIENT, SERVER, 101, 901, 24, h[:40])),
        (60, tcp(SERVER, CLIENT, 901, 101 + len(h), 16)),
        (70, tcp(SERVER, CLIENT, 901, 101 + len(h), 24, b"\x17\x03\x03\x00\x10host.exampleDATA")),
        (65, tcp(CLIENT, SERVER, 101 + len(h), 922, 24, b"\x17\x03\x03\x00\x02ok")),
    ]


@pytest.mark.parametrize("order, nano", [("<", False), (">", False), ("<", True), (">", True)])
def test_records(order, nano):
    got = frames.read_records(pcap(session(), order=order, nano=nano))
    assert [r.timestamp_us for r in got] == [10, 20, 30, 40, 50, 60, 70, 65]


def test_bad_captures():
    good = pcap(session())
    for bad in (b"", good[:24], good[:-1], good[:30], pcap(session(), link=101), b"\0" * 40):
        with pytest.raises(frames.CaptureError):
            frames.read_records(bad)
    with pytest.raises(frames.CaptureError):
        frames.read_records(pcap(session(), nano=True), nanoseconds=False)


def test_decode():
    f = tcp(CLIENT, SERVER, 2**32 - 1, 0, 2, b"x", vlan=True)
    assert frames.try_ipv4_tcp(f).sequence == 2**32 - 1 and frames.try_ipv4_tcp(f).payload == b"x"
    assert frames.try_ipv4_tcp(tcp(CLIENT, SERVER, 1, 0, 2, fragment=0x2000)) is None
    assert frames.try_ipv4_tcp(tcp(CLIENT, SERVER, 1, 0, 2, v6=True)) is None
    assert frames.decode_tcp(tcp(CLIENT, SERVER, 1, 0, 2, b"yz", v6=True)).payload == b"yz"
    assert frames.decode_tcp(f[:-1]).repaired
    assert frames.try_ipv4_tcp(b"short") is None


def test_segments():
    assert frames.join_segments([(5, 0, b"abc"), (7, 1, b"cde"), (5, 2, b"abc"), (20, 3, b"z"), (6, 4, b"b")]) == [b"abcde", b"z"]
    assert frames.join_segments([(0, 0, b"abcd"), (2, 1, b"XYZ")]) == [b"abcd", b"XYZ"]
    assert frames.join_segments([]) == []


def test_names():
    assert frames.server_names(pcap(session())) == ["host.example"]
    assert set(frames.stream_names(b"junk" + hello(b"a.example") + hello(b"b.example", b"c.example"))) == {"a.example", "b.example", "c.example"}
    assert frames.hello_names(b"\0" * 34) == [] and frames.hello_names(b"") == []
    assert frames.normal_host("-bad.example") is None and frames.normal_host("münchen.example") == "xn--mnchen-3ya.example"


def test_sessions_of_a_capture():
    again = [(80, tcp(CLIENT, SERVER, 100, 0, 2)), (90, tcp(CLIENT, SERVER, 5000, 0, 2)), (95, b"\0" * 20)]
    found, skipped = frames.capture_sessions(pcap(session() + again))
    assert [s["packets"] for s in found] == [9, 1] and skipped == 1
    assert frames.read_records(found[1]["content"])[0].timestamp_us == 90


def test_sanitize_and_trim():
    raw = pcap(session())
    out = sanitize.sanitize(raw, key=b"k", label="host.example", anchor_us=1_000_000_000)
    assert out["input_packets"] == 8 and out["dropped_indices"] == "0:tcp_syn;1:tcp_syn;2:tcp_third_ack;3:tls_handshake;4:tls_handshake"
    assert out["retained_indices"] == "5,7,6" and out["timestamp_inversions"] == 1 and out["masked_retained_bytes"] == 12
    records = frames.read_records(out["content"])
    assert [r.timestamp_us for r in records] == [1_000_000_000, 1_000_000_005, 1_000_000_010]
    packets = [frames.decode_tcp(r.frame, repair=False) for r in records]
    assert packets[2].payload.endswith(b"x" * 12 + b"DATA") and packets[0].source[0] == 172 and packets[1].source[0] == 10
    for r in records:  # both checksums are right
        ip = r.frame[14:34]
        assert sanitize.internet_checksum(ip) == 0
        length = int.from_bytes(ip[2:4], "big")
        segment = r.frame[34 : 14 + length]
        assert sanitize.internet_checksum(ip[12:20] + struct.pack("!BBH", 0, 6, len(segment)) + segment) == 0
    assert sanitize.sanitize(raw, key=b"k", label="host.example", anchor_us=1_000_000_000) == out
    trimmed = sanitize.trim_to_payload(out["content"], indices=out["retained_indices"], anchor_us=5_000_000)
    assert trimmed["leading_ack_removed"] == 1 and trimmed["retained_indices"] == "7,6" and trimmed["removed_indices"] == "5"
    with pytest.raises(frames.CaptureError):
        sanitize.trim_to_payload(out["content"], indices="1", anchor_us=0)
    with pytest.raises(frames.CaptureError):
        sanitize.sanitize(pcap(session()[:3]), key=b"k", label="x", anchor_us=0)
    with pytest.raises(frames.CaptureError):
        sanitize.campaign_anchor("1999/x.pcap")


def test_checksum_is_the_sum_of_words():
    assert sanitize.internet_checksum(bytes.fromhex("0001f203f4f5f6f7")) == 0x220D
    assert sanitize.internet_checksum(b"\0\0") == 0xFFFF


def test_capture_frames(spark, tmp_path):
    (tmp_path / "2026").mkdir()
    (tmp_path / "2026" / "a.pcap").write_bytes(pcap(session()))
    (tmp_path / "2026" / "bad.pcap").write_bytes(b"nothing")
    (tmp_path / "2026" / "._a.pcap").write_bytes(b"fork")
    c = captures.read_captures(spark, str(tmp_path))
    assert c.count() == 2
    packets = captures.capture_packets(c)
    assert packets.where("error is null").count() == 8 and packets.where("error is not null").count() == 1
    report = {r.path.rsplit("/", 1)[1]: r.status for r in captures.session_report(captures.session_captures(c, version="v1")).collect()}
    assert report == {"a.pcap": "accepted", "bad.pcap": "skipped_rejected_capture"}
    good = c.where("path like '%/a.pcap'").selectExpr("path", "content", "'2026/a.pcap' rel", "'host.example' label")
    named = captures.capture_names(good).selectExpr("path", "server_names", "10 as bytes", "'w' as planned")
    allowed = spark.createDataFrame([("host.example", "v")], "host string, class_name string")
    assert captures.annotate(named, allowed, size="bytes", minimum=5).first().status == "accepted"
    assert captures.annotate(named, allowed, size="bytes", minimum=5, scheduled="planned").first().rejection_reason == "scheduled_class_mismatch"
    clean = captures.sanitize_captures(good, key=b"k", relative="rel", label="label")
    assert clean.first().output_packets == 3 and captures.sanitize_report(clean).first().errors == 0
    trimmed = captures.trim_captures(clean.withColumnRenamed("path", "p").withColumnRenamed("sanitized_path", "path"), relative="path", indices="retained_indices")
    assert captures.payload_positions(trimmed).collect()[0].leading_ack_removed == 1
    digest = clean.first().source_sha256
    manifest = spark.createDataFrame([(good.first().path, digest), (good.first().path, "0"), ("nowhere", "0")], "file string, sha string")
    assert sorted(r.binding for r in captures.bound_to_manifest(good, manifest, path="file", digest="sha").collect()) == ["hash_mismatch", "missing", "ok"]


def test_capture_source(spark, tmp_path):
    from packetlens.sources.pcap import register

    (tmp_path / "a.pcap").write_bytes(pcap(session()))
    register(spark)
    df = spark.read.format("capture").load(str(tmp_path))
    assert df.count() == 8 and df.agg({"payload_length": "max"}).first()[0] > 0
