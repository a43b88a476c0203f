from __future__ import annotations

import hashlib
import hmac
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from footfall import schemas
from footfall.functions.decode import leading_int, parameter_text, url_origin
from footfall.functions.identity import hmac_hex
from footfall.functions.network import (
    ipv4_number,
    ipv4_range,
    ipv6_hex,
    ipv6_range,
    next_hex,
    unmapped,
)
from footfall.functions.referrer import referrer_class
from footfall.functions.useragent import browser_name, browser_version, device_class, os_name
from footfall.plans.anonymize import anonymize_events, anonymize_views
from footfall.plans.scoring import with_bot_score
from footfall.plans.threats import Feeds, accept_feed, checked_patterns, with_agent_flags, with_threat_flags
from footfall.settings import Settings
from tests.conftest import NOW, texts

# --- score factors: change of one signal from a clean request ----------------------------

SIGNALS = dict(
    cf_bot_score=None, cf_verified_bot=None, is_spa=False, interaction_ms=2000, country_code="NO",
    site_id="site", burst_count=1, accept_language="en", sec_ch_ua="x", sec_fetch_site="y", sw="1920",
    sh="1080", referrer="https://a.example", path="/a/b", crawler_match=False, ai_crawler_match=False,
    datacenter_ip=False, pow_result="valid", ip_penalty=0,
)
FACTORS = [
    ({}, 0, {}),
    (dict(cf_bot_score="1"), 50, {"cf": 50}),
    (dict(cf_bot_score="29"), 30, {"cf": 30}),
    (dict(cf_bot_score="50"), 10, {"cf": 10}),
    (dict(cf_bot_score="51"), 0, {}),
    (dict(cf_bot_score="1", cf_verified_bot="true"), 15, {"cf": 15}),
    (dict(cf_bot_score="0"), 0, {}),
    (dict(interaction_ms=849), 20, {"timing": 20}),
    (dict(interaction_ms=999), 8, {"timing": 8}),
    (dict(interaction_ms=0, is_spa=True), 0, {}),
    (dict(country_code="CN"), 30, {"geo": 30}),
    (dict(country_code="RU", site_id="Shop"), 30, {"geo_site": 30}),
    (dict(country_code="CN", site_id="shop"), 60, {"geo": 30, "geo_site": 30}),
    (dict(burst_count=15), 0, {}),
    (dict(burst_count=16), 25, {"burst": 25}),
    (dict(accept_language=None), 10, {"headers": 10}),
    (dict(sec_ch_ua=None), 0, {}),
    (dict(sec_ch_ua=None, sec_fetch_site=None, accept_language=None), 20, {"headers": 20}),
    (dict(sw="0"), 10, {"screen": 10}),
    (dict(sh=None), 10, {"screen": 10}),
    (dict(sw=None, sh=None), 0, {}),
    (dict(sw="abc"), 0, {}),
    (dict(sw="10001"), 10, {"screen": 10}),
    (dict(referrer="direct_or_unknown"), 5, {"referrer": 5}),
    (dict(referrer="direct_or_unknown", path="/a//"), 0, {}),
    (dict(crawler_match=True), 30, {"crawler_feed": 30}),
    (dict(ai_crawler_match=True), 40, {"ai_crawler_feed": 40}),
    (dict(datacenter_ip=True), 15, {"datacenter_ip": 15}),
    (dict(pow_result="invalid"), 50, {"pow": 50, "pow_result": "invalid"}),
    (dict(pow_result=None), 50, {"pow": 50, "pow_result": "missing"}),
    (dict(ip_penalty=20), 20, {"bot_ip": 20}),
    (dict(cf_bot_score="1", country_code="CN", ai_crawler_match=True, pow_result="missing"), 100,
     {"cf": 50, "geo": 30, "ai_crawler_feed": 40, "pow": 50, "pow_result": "missing"}),
]


def test_score_factors(spark):
    ddl = ", ".join(
        f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'string'}"
        for k, v in SIGNALS.items()
    )
    data = [tuple((SIGNALS | change).values()) for change, _, _ in FACTORS]
    config = Settings(behind_cloudflare=True, site_suspect_countries={"shop": ("CN", "RU")})
    # one partition keeps the rows in order
    got = with_bot_score(spark.createDataFrame(data, ddl).coalesce(1), config).collect()
    assert [(r.bot_score, json.loads(r.bot_score_detail)) for r in got] == [(s, d) for _, s, d in FACTORS]


# --- parsing -------------------------------------------------------------------------------


def test_referrer_classes(spark):
    cases = {
        "https://www.google.com": "search", "https://google.no/x": "search", "https://news.google.de": "search",
        "https://duckduckgo.com": "search", "https://t.co/a": "social", "https://old.reddit.com": "social",
        "https://x.com": "social", "https://chatgpt.com": "ai", "https://gemini.google.com": "ai",
        "https://example.com": "direct_or_unknown", "https://notgoogle.com": "direct_or_unknown",
        "direct_or_unknown": "direct_or_unknown", "not a url": "direct_or_unknown", "": "direct_or_unknown",
    }
    assert texts(spark, list(cases), referrer_class) == list(cases.values())


AGENTS = {
    "Mozilla/5.0 (Windows NT 10.0; Win64) Chrome/120.0.0.0 Safari/537.36": ("Windows 10/11", "Chrome", "120.0.0.0"),
    "Mozilla/5.0 (Windows NT 6.3) Chrome/1.2 Safari/5 Edg/119.0.1": ("Windows 8.1", "Edge", "119.0.1"),
    "Mozilla/5.0 (Windows NT 5.1) Gecko Firefox/52.0": ("Windows NT 5.1", "Firefox", "52.0"),
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) Version/17.2 Safari/605": ("macOS 10.15.7", "Safari", "17.2"),
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_2) Chrome/120.0 OPR/106.0": ("macOS 14", "Opera", "106.0"),
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2_1 like Mac OS X) CriOS/120.0": ("iOS 17.2.1", "Chrome", "120.0"),
    "Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) FxiOS/118.0": ("iOS 16.6", "Firefox", "118.0"),
    "Mozilla/5.0 (Linux; Android 13) SamsungBrowser/23.0 Chrome/115": ("Android 13", "Samsung Browser", "23.0"),
    "Mozilla/5.0 (Linux; Android 8.1) UCBrowser/13.4": ("Android 8.1", "UC Browser", "13.4"),
    "Mozilla/5.0 (X11; CrOS x86_64) Chrome/119.0": ("ChromeOS", "Chrome", "119.0"),
    "Mozilla/5.0 (X11; Linux x86_64) Gecko Firefox/121.0": ("Linux", "Firefox", "121.0"),
    "": (None, None, None),
    "something else": (None, None, None),
}


def test_agents(spark):
    found = lambda x: F.array(os_name(x), browser_name(x), browser_version(x))
    assert [tuple(r) for r in texts(spark, list(AGENTS), found)] == list(AGENTS.values())


def test_devices(value):
    widths = (767, 768, 1024, 1025, None)
    got = value(*[device_class(F.lit(w).cast("int")) for w in widths])
    assert got == ("mobile", "tablet", "tablet", "desktop", None)


def test_decoding(spark):
    assert texts(spark, ["900abc", " -7", "x", ""], leading_int) == [900, -7, None, None]
    got = texts(spark, ["L2ErYg==", "L2ErYg", "JUMzJUE5", "JUcx", "***", None], lambda x: parameter_text(x))
    assert got == ["/a+b", "/a+b", "é", None, None, None]
    urls = ["https://A.example:443/x?y", "http://a.example:8080", "nonsense", "app://thing", "http://a b"]
    assert texts(spark, urls, url_origin) == ["https://a.example", "http://a.example:8080", None, "null", None]


def test_hmac_matches_the_standard_library(spark):
    for secret in ("k", "long" * 40):
        got = texts(spark, ["", "abc", "æøå"], lambda x, s=secret: hmac_hex(s, x))
        assert got == [hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest() for t in ("", "abc", "æøå")]


@settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=60), min_size=150, max_size=200))
def test_arbitrary_text_never_fails(spark, lines):
    lines = [x.replace("\0", "").encode("utf-8", "ignore").decode() for x in lines]
    everything = lambda x: F.struct(
        os_name(x), browser_name(x), browser_version(x), referrer_class(x), url_origin(x), parameter_text(x),
        leading_int(x), ipv4_number(unmapped(x)), ipv6_hex(x),
    )
    assert len(texts(spark, lines, everything)) == len(lines)


# --- addresses --------------------------------------------------------------------------------


def test_ipv4(spark):
    cases = {"0.0.0.0": 0, "255.255.255.255": 2**32 - 1, "10.0.0.1": 167772161, "256.0.0.1": None,
             "1.2.3": None, "0x10.1.1.1": None, "1.2.3.4 ": None, "99999999999.1.1.1": None}
    assert texts(spark, list(cases), ipv4_number) == list(cases.values())
    assert texts(spark, ["::ffff:1.2.3.4", "::1.2.3.4", "::FFFF:1.2.3.4", "::1"], unmapped) == ["1.2.3.4"] * 3 + ["::1"]


def test_prefixes(value):
    def v4(text, bits):
        return ipv4_range(ipv4_number(F.lit(text)), F.lit(bits))

    def v6(text, bits):
        return ipv6_range(ipv6_hex(F.lit(text)), F.lit(bits))

    got = value(
        v4("10.1.2.3", 8), v4("10.1.2.3", 32), v4("1.2.3.4", 0), v4("192.168.1.77", 24), v4("1.2.3.4", 33),
        v6("2001:db8::", 32), v6("2001:db8::1", 128), v6("::", 0), v6("2001:db8:ffff::", 46), v6("::", 129),
    )
    assert [None if g is None else tuple(g) for g in got] == [
        (167772160, 184549375), (167838211, 167838211), (0, 2**32 - 1), (3232235776, 3232236031), None,
        ("0" + "20010db8" + "0" * 24, "0" + "20010db8" + "f" * 24),
        ("0" + "20010db8" + "0" * 23 + "1",) * 2,
        ("0" * 33, "0" + "f" * 32),
        ("020010db8fffc" + "0" * 20, "020010db8ffff" + "f" * 20),
        None,
    ]


def test_ipv6(spark):
    import ipaddress

    good = ["::", "::1", "2001:db8::8:800:200c:417a", "fe80::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "ABCD::"]
    want = ["0" + f"{int(ipaddress.ip_address(a)):032x}" for a in good]
    assert texts(spark, good, ipv6_hex) == want
    bad = ["1.2.3.4", "1::2::3", "12345::", "g::", "1:2:3", ":1::2", "1::2:", ":::", "", "1:2:3:4:5:6:7:8:9"]
    assert texts(spark, bad, ipv6_hex) == [None] * len(bad)
    ends = ["0" * 33, "0" + "f" * 32, "0" + "0" * 30 + "9f"]
    assert texts(spark, ends, next_hex) == ["0" * 32 + "1", "1" + "0" * 32, "0" * 31 + "a0"]


def test_threat_flags(spark):
    v4 = spark.createDataFrame([(167772160, 184549375), (3232235776, 3232236031)], "lo long, hi long")
    v6 = spark.createDataFrame(
        [("020010db8" + "0" * 24, "020010db8" + "f" * 24), ("02600" + "0" * 28, "02607" + "f" * 28)],
        "lo string, hi string",
    )
    rows = [
        (1, "10.200.0.1", "x spider"), (2, "11.0.0.0", "X-AI.Bot"), (3, "::ffff:10.0.0.1", "xAIzBot"),
        (4, "2001:db8:5::1", None), (5, "2606:4700::1", "ok"), (6, "2610::1", "ok"), (7, "unknown", "ok"),
    ]
    hits = spark.createDataFrame(rows, "id int, ip string, user_agent string")
    feeds = Feeds(("SPIDER$", "(broken"), ("AI.bot",), v4, v6)
    got = with_threat_flags(hits, feeds).orderBy("id").collect()
    assert [r.datacenter_ip for r in got] == [True, False, True, True, True, False, False]
    assert [r.crawler_match for r in got] == [True] + [False] * 6
    assert [r.ai_crawler_match for r in got] == [False, True] + [False] * 5


def test_shrunken_feed_is_refused(spark):
    old, small, big = spark.range(100), spark.range(9), spark.range(10)
    assert accept_feed(small, old) is old and accept_feed(big, old) is big
    assert accept_feed(spark.range(0), old) is old and accept_feed(small, None) is small
    assert accept_feed(small, old, shrink=0.0) is small


def test_patterns_are_those_of_the_engine(spark):
    given = ("Bot", "(?<a>x)1", "(?<a>y)2", "(z)\\1", "(?P<n>bot)", "(bad")
    assert checked_patterns(spark, given) == (list(given[:4]), list(given[4:]))
    agents = spark.createDataFrame([("X1",), ("y2",), ("zZ",), ("robot",), ("w",)], "user_agent string")
    found = with_agent_flags(agents, Feeds(given)).filter("crawler_match").collect()
    assert {r.user_agent for r in found} == {"X1", "y2", "zZ", "robot"}


# --- anonymisation ---------------------------------------------------------------------------------

PRIVATE = Settings(secret="s", anonymize_sites=("Site",))


def test_anonymous_views(views):
    full = dict(
        session_id="x", os_name="Linux", browser_name="Firefox", browser_version="121", screen_width=1920,
        screen_height=1080, referrer="https://a.example", utm_source="u", path="/a/b/a",
    )
    table = views(full, full, {"site_id": "other", "path": "/open"}, {"device_type": None, "country_code": None})
    a, b, other, bare = anonymize_views(table, PRIVATE).orderBy("id").collect()
    assert a.asDict() | {"id": 0} == b.asDict() | {"id": 0}
    first, second, third = a.path.strip("/").split("/")
    assert first == third and a.path != full["path"] and len(a.visitor_id) == 16
    assert other.path == "/open"
    assert (bare.device_type, bare.country_code, bare.session_id, bare.screen_width, bare.path) == (None, None, None, None, "/")


def test_anonymous_events(events):
    table = events(
        {"data": '{"tag":"A","path":"/p","href":"https://secret"}', "experiment_id": "e"},
        {"event_type": "form_blur", "data": '{"value":"Ab1 c-\\u00e9","field_name":"q","other":1}'},
        {"event_type": "custom", "data": '{"name":"x"}', "device_type": "mobile"},
        {"data": "{bad"},
        {"event_type": "scroll_depth", "data": '{"depth":50,"path":"/p"}'},
    )
    click, blur, custom, bad, scroll = anonymize_events(table, PRIVATE).orderBy("id").collect()
    assert json.loads(click.data) == {"tag": "A", "path": "/p"} and click.experiment_id.startswith("experiment-")
    typed = json.loads(blur.data)["value"]
    assert len(typed) == 7 and typed[3] == " " and typed[5:] == "-é" and typed != "Ab1 c-é"
    assert typed[0].isupper() and typed[1].islower() and typed[2].isdigit()
    assert (custom.data, bad.data, custom.device_type, click.device_type) == ("{}", "{}", "small", "other")
    assert scroll.data == '{"depth":50,"path":"/p"}'


def test_days_have_different_pseudonyms(views):
    from datetime import timedelta

    table = views({}, {"created_at": NOW + timedelta(days=1)})
    assert len({r.visitor_id for r in anonymize_views(table, PRIVATE).collect()}) == 2
    assert anonymize_views(table, Settings()).collect() == table.collect()
    assert table.schema == schemas.VIEWS
