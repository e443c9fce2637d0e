"""Inline rows for features that the driver's tables lack."""

BYTES = [(1, b"plain"), (2, "é ü".encode()), (3, b"bad \xff byte"), (4, b""), (5, None)]
SEED_LINES = ["# seeds", "", " https://www.example.com/sport ", "https://example.org/", "   ", "#x", "http://news.example.co.uk/a"]
LIST_LINES = ["# list", "alpha", "  beta ", "", "\t", "# gamma", "delta # no comment here"]
LEMMA_LINES = ["goals\tgoal", "no tab here", "scored\tscore"]
QUERY_LINES = ["q01 | one goal | first", "q02 | two goals | second", "q03|three|"]
ROBOT_URLS = ["http://a.example.com/", "http://a.example.com/private/x", "http://b.example.com/any", "http://c.example.com", "http://d.example.com/p?q=1"]
ROBOT_RULES = [("http://a.example.com", "/private", 5.0), ("http://a.example.com", "/tmp", None), ("http://b.example.com", "/", 0.5), ("http://d.example.com", "", None)]
#: (href, base)
URLS = [
    ("HTTP://WWW.Example.com:80//a//b/?utm_source=x&q=1#f", None), ("http://example.com:443/", None), ("/x/", "https://example.com/y"), ("mailto:a@b.c", None), ("http://localhost/", None),
    ("https://example.com:8080/a", None), ("//cdn.example.org/x", "https://example.com/y"), ("?page=2", "https://example.com/y?old=1"), ("rel/z", "https://example.com/d/y"), ("http://user@example.com/q?&&a=1&gclid=2&b", None),
    ("../d", "http://a.example.com/b/c"), ("./e/../f?x=/../y", "https://example.com/p/q/"), ("/a/./b/..", "https://example.com/z"), ("../../../up#x", "https://example.com/a/b"),
]
HOSTS = ["news.bbc.co.uk", "www.goal.com", "a.b.c.com", "co.uk", "www.example.com:8080", "single"]
CRAWL_URLS = ["http://example.com/sport/rugby/x", "http://example.com/sport/la-liga/x", "http://example.com/a.pdf", "http://shop.example.com/a", "http://other.net/a", "http://example.com/A.PDF/x", "http://example.com/"]
PRIORITY_URLS = [("http://e.com/", 0), ("http://e.com/sport/news/2026/03/a", 1), ("http://e.com/archive/2010/05/06/x", 2), ("http://e.com/a/b/c/d/e/f/g/h", 3), ("http://e.com/match/2021-05/x", 0)]
DATED_PAGES = [
    (1, '<meta property="article:published_time" content="2020-01-02T03:04">'), (2, '<meta name="date" content="2 May 2021"><time datetime="x">'), (3, '<nav><time datetime="gone"></nav><p><time datetime="2019-05-06">6 May</time></p>'),
    (4, "<p>none</p>"), (5, '<script type="application/ld+json">{"datePublished": "2018-01-01"}</script>'), (6, f'<meta itemprop="datePublished" content="{"9" * 50}">'),
]
SIZES = [(100.0, 0.0), (2048.0, 59.9), (5_300_000.0, 3661.0), (7_600_000_000.0, 90_061.0)]
REPORT = [(1, 1.23e9, 12.34, 1234567, 1000000), (2, 5.6e6, 89.96, 5, 0), (3, None, None, None, 7), (4, 1.0e6, 125.2, 1004, 1000), (5, 2.0e9, 7500.0, 800, 1000)]
RULE_TEXT = """
# keep rules
host = src1
host = src12
url = /es$
title = \\b(the|der) \\w+
title_hits = 4 :: on|en
title_hits_except_host = src3
"""
ENTITY_TEXTS = [(1, "Man City vs man utd"), (2, "the UEFA Champions  League"), (3, "Premier League Cup"), (4, "brighton & hove albion"), (5, "Spursy spurs"), (6, "")]
NAME_TEXTS = [(1, "said Kaizer Chiefs today"), (2, "The Old Trafford's roof"), (3, "Alone here"), (4, "And The End")]
DATE_TEXTS = [(1, "May 6, 2010"), (2, "6th of May, 2010"), (3, "06/05/2010"), (4, "13/13/2010"), (5, "on Sept. 3rd 2011 and 1 jan 2012"), (6, "32 May 2010")]
NUMBER_TEXTS = [(1, "1,234,567 fans"), (2, "1,23"), (3, "12,345,6"), (4, "a,123"), (5, "9,999 and 1,000,000.")]
POSSESSIVES = [(1, "Arsenal's"), (2, "O'Neil"), (3, "O’Neil’s"), (4, "plain"), (5, "'s"), (6, "boys'")]
#: Examples of the published algorithm.
STEMS = [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"),
    ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"),
    ("operator", "oper"), ("hopefulness", "hope"), ("formaliti", "formal"), ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adjustable", "adjust"),
    ("replacement", "replac"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("news", "new"), ("is", "is"),
]
POLICY_TEXT = "[normalise]\nlowercase = yes\n"
TERM_LISTS = [(1, ["a", "b", "c"], ["a", "x", "c"]), (2, ["a", "b"], ["a", "x"]), (3, ["a"], ["a"]), (4, ["p", "q"], ["p"])]
BUILDS = [("A", 847186, 353851101, 796600000, 266.0), ("B", 914759, 301803447, 695400000, 539.0), ("C", 895060, 284645208, 655200000, 640.0), ("D", 847027, 300254717, 689300000, 271.0), ("E", 831032, 280784995, 644100000, 506.0), ("F", 914752, 301555100, 694900000, 534.0)]
STOPWORD_PARTS = (["the", "won", "will", "don't", "of", "a"], ["won", "will", "can"], ["s", "t"], ["could", "also", "of"])
LEMMA_COUNTS = [("goals", 50), ("goal", 90), ("scored", 30), ("score", 40), ("children", 25), ("child", 5), ("meeting", 60), ("boss", 70), ("was", 900), ("spurs", 80), ("stories", 22), ("story", 21), ("rare", 3), ("feet", 40), ("playing", 33), ("play", 80), ("x1s", 99)]
LEMMA_CANDIDATES = [("goals", "goal", None), ("scored", "scored", "score"), ("stories", "story", None), ("playing", "playing", "play"), ("feet", "foot", None), ("meeting", "meeting", "meet"), ("boss", "bos", None)]
