import pytest

from tidewell.functions import codec, extract, text_rules, web_rules
from tidewell.operators.checkpoint import valid_key


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Straße", ("strasse", "Straße", None)),
        ("ＣＡＦÉ", ("café", "CAFÉ", None)),
        ("two-words", ("two-words", "two-words", None)),
        ("NSFW", (None, None, "filtered_tag")),
        ("class", ("class", "class", None)),
        ("-x", (None, None, "malformed_tag")),
        ("a b", (None, None, "malformed_tag")),
        ("___", (None, None, "malformed_tag")),
        ("x" * 65, (None, None, "malformed_tag")),
        (123, (None, None, "malformed_tag")),
        (None, (None, None, "malformed_tag")),
        ("", (None, None, "malformed_tag")),
    ],
)
def test_tag(value, want):
    assert text_rules.tag(value) == want


def test_tags_in_text():
    assert text_rules.tags_in("#one a#two ##three #日本語, #a-b- #- x #é") == ["one", "日本語", "a-b", "é"]


def test_emoji_and_sentiment():
    family = "👨‍👩‍👧"
    assert text_rules.emojis(f"🔥🔥 {family} ❤️") == ["🔥", "🔥", family, "❤️"]
    assert text_rules.sentiment("I love it, sad but good 😢") == 0.0
    assert text_rules.sentiment("plain") is None
    assert text_rules.primary_language("pt-BR") == "pt" and text_rules.primary_language("x") == "und" and text_rules.primary_language(3) == "und"


@pytest.mark.parametrize(
    ("url", "uri"),
    [
        ("HTTPS://News.Example.com:443?utm_source=a&id=42&%75tm_medium=b#f", "https://news.example.com/?id=42"),
        ("http://example.com:8080/a?b=1&b=2", "http://example.com:8080/a?b=1&b=2"),
        ("https://bücher.example/x", "https://xn--bcher-kva.example/x"),
        ("https://[2606:4700::1111]/", "https://[2606:4700::1111]/"),
    ],
)
def test_link(url, uri):
    assert web_rules.link(url)[0] == uri
    assert web_rules.link(uri)[0] == uri


@pytest.mark.parametrize(
    ("url", "reason"),
    [
        ("ftp://example.com/", "unsafe_scheme"),
        ("https://user@example.com/", "unsafe_host"),
        ("https://127.0.0.1/", "unsafe_host"),
        ("https://2130706433/", "unsafe_host"),
        ("https://169.254.169．254/", "unsafe_host"),
        ("https://10-0-0-1.example.com/", "unsafe_host"),
        ("https://[::ffff:10.0.0.1]/", "unsafe_host"),
        ("https://my.localdev.example/", "unsafe_host"),
        ("https://a.nip.io/", "unsafe_host"),
        ("https://printer.lan/", "unsafe_host"),
        ("https://sub.xvideos.com/", "filtered_domain"),
        ("https://example.com/%zz", "malformed_url"),
        ("https://example.com/a b", "malformed_url"),
        ("https://example.com:0/", "malformed_url"),
        ("https://example.com/" + "x" * 2048, "malformed_url"),
        (7, "malformed_url"),
        (None, "malformed_url"),
    ],
)
def test_bad_link(url, reason):
    assert web_rules.link(url) == (None, None, reason)


def post(text="", langs=None, facets=None, did="did:a", t=1_700_000_000_000_000, **record):
    return {"did": did, "time_us": t, "kind": "commit", "commit": {"operation": "create", "collection": extract.COLLECTION, "record": {"text": text, "langs": langs, "facets": facets} | record}}


def facet(**f):
    return {"features": [f]}


TAG, LINK = "app.bsky.richtext.facet#tag", "app.bsky.richtext.facet#link"


def test_features():
    facets = [facet(**{"$type": TAG, "tag": t}) for t in ("Spam", "#spam", 5, 6, "One", "one")] + [facet(**{"$type": LINK, "uri": u}) for u in ("https://example.com/a?fbclid=1", "https://example.com/a", "x")]
    got = extract.features(post("🔥🔥 #ignored", ["ja-JP"], facets))
    assert got["tags"] == ["one"] and got["labels"] == {"one": "One"} and got["lang"] == "ja"
    assert got["links"] == ["https://example.com/a"] and got["domains"] == ["example.com"] and got["emoji"] == ["🔥"]
    assert got["exclusions"] == {"malformed_tag": 1, "filtered_tag": 1, "duplicate_in_event_tag": 1, "duplicate_in_event_url": 1, "duplicate_in_event_domain": 1, "duplicate_in_event_emoji": 1, "unsafe_scheme": 1}


def test_caps_and_other_events():
    many = extract.features(post(" ".join(f"#t{i}" for i in range(40))))
    assert len(many["tags"]) == 32 and many["exclusions"] == {"candidate_limit_tag": 8}
    for bad in ({}, [], None, post() | {"kind": "identity"}, post() | {"time_us": "5"}, post() | {"commit": 3}):
        assert extract.features(bad) is None
    assert extract.features(post(did="\ud800"))["source"] is None
    assert extract.decode('{"time_us": 1', 0) is None and extract.decode("[" * 100_000, 0) is None
    assert extract.shallow_time('{"a": {"time_us": 1}, "time_us": 25, "b": "\\"time_us\\": 3"}') == 25
    for text, want in (('{"time_us": 2.5}', None), ('[{"time_us": 3}]', None), ('{"time_us": 12abc}', None), ('{"time_us": 4, "time_us": 5}', 4), (' {"a": [1], "time_us" : 6 }', 6), ('{"time_us": -1}', None), ('{"time_us": 99999999999999999999}', None), ('"time_us": 7', None), ('{"time_us": 8', None)):
        assert extract.shallow_time(text) == want
    assert extract.judge("{", 0)[0] == "malformed" and extract.judge(None, 0)[0] == "malformed"
    key = bytes(32)
    assert len(extract.source_digest("did:a", key)) == 32 and extract.source_digest(None, key) is None and extract.source_digest("did:a", key) != extract.source_digest("did:a", b"1" * 32)


def test_codec():
    doc = {"b": [1, -1, 300, -40_000, 1 << 40, 2.5, None, True], "a": "é" * 40, "c": b"x", "d": {str(i): i for i in range(20)}}
    assert codec.unpack(codec.pack(doc)) == doc
    assert codec.pack({}) == b"\x80" and codec.pack(["1h"]) == b"\x91\xa21h"
    for bad in (b"", b"\x80\x80", b"\xa5abc", b"\xc1"):
        with pytest.raises(ValueError):
            codec.unpack(bad)
    report = codec.verify(codec.pack(doc), codec.checksum(codec.pack(doc)))
    assert report["matches"] and report["valid"] and not codec.verify(b"CK\x00")["valid"]
    with pytest.raises(ValueError):
        codec.parse_checksum("xyz")
    assert codec.key("n", "op", "5m").startswith("n:op:") and len(codec.key("n", "op", "5m")) == 5 + 64


def test_valid_keys():
    assert valid_key("tag", "strasse") and not valid_key("tag", "Straße")
    assert valid_key("emoji", "🔥") and not valid_key("emoji", "x") and valid_key("lang", "und") and not valid_key("lang", "EN")
