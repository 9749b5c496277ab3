"""Pages for op4's tests, written apart from its training pages: names that no list holds, bare markup, line breaks, short articles,
titles in headers, remarks of two entries.  Each with the words that belong to its main text."""

P1 = "Herons came back to the lake in March, two weeks sooner than last year. Wardens counted forty nests along the northern bank."
P2 = "The water stands high, and the reeds have grown dense. Nobody knows yet whether the young will find enough fish."
P3 = "A fence keeps walkers off the bank until July. After that the path is open again, as it has been for decades."
S1, S2 = "What a lovely piece, my father took me there when I was small.", "I disagree with the fence, it spoils the view for all of us."
MENU = '<div class="qzr"><a href="/">Start</a> <a href="/lake">Lake</a> <a href="/us">About us</a></div>'
IMPRINT = '<div class="vvt">Imprint 2024</div>'

PAGES = [
    (f"<body><div><p>{P1}</p></div></body>", P1),
    (f"<html><body>{MENU}<div class=kk3>{P1}<br><br>{P2}</div>{IMPRINT}</body></html>", f"{P1} {P2}"),
    ("<article><p>Short text.</p></article>", "Short text."),
    (f"<body>{MENU}<article><header><h1>Herons are back</h1></header><p>{P1}</p><p>{P2}</p></article><footer>Lake News</footer></body>", f"Herons are back {P1} {P2}"),
    (f'<body><main><h1>Herons</h1><p>{P1}</p><p>{P2}</p></main><div class="guestbook"><div><b>Ann</b><p>{S1}</p></div><div><b>Bo</b><p>{S2}</p></div></div></body>', f"Herons {P1} {P2}"),
    (f'<body>{MENU}<div class="trunk"><h1>Herons</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div class="visitor-voices-list"><div class="v"><span>Ann</span><p>{S1}</p></div><div class="v"><span>Bo</span><p>{S2}</p></div></div>{IMPRINT}</body>', f"Herons {P1} {P2} {P3}"),
    (f'<body><div id="top9"><a href="/">Lake News</a></div><div id="mid9"><h2>Herons</h2><p>{P1}</p><p>{P2}</p><ul><li>Forty nests on the bank.</li><li>Two closed paths.</li></ul><p>{P3}</p></div><div id="end9"><a href="/i">Imprint</a> | <a href="/p">Privacy</a></div></body>', f"Herons {P1} {P2} Forty nests on the bank. Two closed paths. {P3}"),
    (f'<body>{MENU}<div class="kpl"><div class="oo1"><p>{P1}</p><p>{P2}</p></div><div class="oo2"><h3>Read on</h3><ul><li><a href="/a">Ten lakes worth a walk this spring</a></li><li><a href="/b">Where the storks went</a></li><li><a href="/c">Frogs on the road</a></li></ul></div></div></body>', f"{P1} {P2}"),
    (f'<body><div class="lay"><p>We keep small files on your device. Read how and why.</p><button>Fine</button></div>{MENU}<div class="zu"><p>{P1}</p><p>{P2}</p><p>{P3}</p></div></body>', f"{P1} {P2} {P3}"),
    (f'<body><table><tr><td><a href="/">Start</a><br><a href="/b">Birds</a></td><td><h1>Herons</h1><p>{P1}</p><p>{P3}</p></td></tr></table></body>', f"Herons {P1} {P3}"),
    (f'<body>{MENU}<section class="hhq"><h1>Herons</h1><blockquote>{P2}</blockquote><p>{P1}</p><form class="ff"><p>Get our letter each week.</p><input><button>Go</button></form><p>{P3}</p></section>{IMPRINT}</body>', f"Herons {P2} {P1} {P3}"),
    (f"<body><h1>Herons</h1>{P1}<br>{P2}<br>{P3}<hr><small>Written by hand, 1999</small></body>", f"Herons {P1} {P2} {P3}"),
]

#: written after the model was settled, to measure it once more
LATER = [
    (f'<body><div class="bb"><a href="/">Lake News</a> <a href="/w">Weather</a></div><div class="story7"><h1>Nests</h1><p>{P2}</p><p>{P3}</p></div><div class="rr8"><h4>Letters</h4><div><i>Cy</i><p>{S2}</p></div><div><i>Di</i><p>{S1}</p></div><div><i>Ed</i><p>{S2}</p></div></div></body>', f"Nests {P2} {P3}"),
    (f"<body><section><header><h1>A cold spring</h1></header>{P3}<br><br>{P1}<br><br>{P2}</section><div><a href=/i>Imprint</a></div></body>", f"A cold spring {P3} {P1} {P2}"),
    (f'<html><body><div class="w"><div class="l3"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li><li><a href="/3">Three</a></li></ul></div><div class="m3"><p>{P1} {P2}</p><p>{P3}</p></div></div></body></html>', f"{P1} {P2} {P3}"),
    (f"<body><main><p>Closed until spring.</p></main><footer>&copy; Lake News</footer></body>", "Closed until spring."),
    (f'<body>{MENU}<div class="t1"><h2>Fish</h2><p>{P2}</p><h2>Walks</h2><p>{P3}</p><table><tr><td>Nests</td><td>Forty, as counted in March.</td></tr></table></div><div class="t2"><form><p>Write to us, we read it all.</p><input><button>Send</button></form></div></body>', f"Fish {P2} Walks {P3} Nests Forty, as counted in March."),
]
