"""Pages made by hand after the extraction was finished, to measure it: blocks that belong to the text begin with Kept. Nothing was chosen by them."""

A = "The committee met on Tuesday and agreed, after some debate, to put the question to all members in the spring."
B = "Nobody had expected so much rain in one week, and the small bridge by the mill was closed until further notice."
C = "She measured the length of every leaf twice, wrote both numbers down, and took the mean of the two."
D = "It is cheap, it is light, and it does what it says on the box, which is more than most of its rivals can claim."
E = "If the lamp stays dark, check the fuse first; only then open the case and look at the wires inside."


def links(*names: str) -> str:
    return "".join(f'<li><a href="/{n}">{n}</a></li>' for n in names)


def kept(*texts: str) -> str:
    return "".join(f"<p>Kept {t}</p>" for t in texts)


PAGES = [
    f"<body><nav><ul>{links('Start', 'News', 'Contact')}</ul></nav><article><h1>Kept title</h1>{kept(A, B)}</article><footer><p>All rights reserved.</p></footer></body>",
    f"<div id=menu><ul>{links('Home', 'Shop')}</ul></div><div id=content><h1>Kept heading</h1>{kept(A)}<p>Kept: no.</p>{kept(B)}</div><div id=footer><p>Imprint and privacy.</p></div>",
    f"<div><p><a href=/>Back</a></p></div><div><h2>Kept name</h2>{kept(C, D)}<p>Kept end.</p></div><div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div>",
    f"<main><h1>Kept head</h1>{kept(A)}<div class=promo><p>Subscribe today! {B}</p></div>{kept(C)}</main><aside><h3>Popular</h3><ul>{links('A story', 'One more story')}</ul></aside>",
    f"<table><tr><td width=150><a href=1>Archive</a><br><a href=2>Links</a></td><td><h1>Kept title</h1><p>Kept {D}<p>Kept {E}</td></tr><tr><td colspan=2>&copy; 1999 by me</td></tr></table>",
    f"<section class=hero><h1>Kept headline</h1><p>Kept short lead.</p></section><section class=body>{kept(A, E)}<figure><figcaption>Kept picture of the bridge.</figcaption></figure></section><section class=related><h2>Related</h2><p>{B}</p></section>",
    f"<article>{kept(A)}<blockquote><p>Kept {B}</p></blockquote><ul><li>Kept first point</li><li>Kept second point</li></ul>{kept(C)}</article><div class=comments><p>Great! {D}</p><p>No. {E}</p></div>",
    f"<div class=topbar>Call us: 555 0100</div><div class=page><div class=entry><h1>Kept name</h1>{kept(D, E)}</div><div class=widget><h4>Tags</h4><a href=1>tea</a> <a href=2>milk</a></div></div>",
    f"<body><header><p>The Daily Thing</p></header><div role=main><h1>Kept news</h1>{kept(B, A)}</div><div role=complementary><p>{C}</p></div><footer>Printed daily.</footer></body>",
    f"<div><h1>Kept recipe</h1><ul><li>Kept two eggs</li><li>Kept some flour</li></ul><ol><li>Kept {E}</li><li>Kept stir.</li></ol></div><div><ul>{links('Soup', 'Bread', 'Cake')}</ul></div>",
    f"<div class=cookie-consent><p>We value your privacy. {A}</p><button>OK</button></div><div class=post><h2>Kept post</h2>{kept(B, C)}</div>",
    f"<dl><dt>Kept term</dt><dd>Kept {A}</dd><dt>Kept other term</dt><dd>Kept {C}</dd></dl><p><a href=next>Next chapter</a></p>",
    f"<div id=wrap class='has-sidebar'><div class=text>{kept(A, B, C)}</div><div class=sidebar><p>About: {D}</p></div></div>",
    f"<article><header><h1>Kept title</h1><p>Kept by A. Writer</p></header>{kept(E)}<div class=share><a href=x>Share</a> <a href=y>Send</a></div>{kept(D)}</article><nav>{links('Older', 'Newer')}</nav>",
    f"<p>Kept {A}</p><p>Kept {B}</p><hr><p><a href=a>Home</a> | <a href=b>Up</a> | <a href=c>Next</a></p>",
    f"<div class=login-box><form><label>User</label><input><button>Go</button></form></div><div class=story>{kept(C)}<h3>Kept part two</h3>{kept(D)}</div><div class=newsletter><p>Get it weekly. {E}</p></div>",
    f"<main><article><h1>Kept story</h1>{kept(A)}</article><section class=comments><article><p>First! {B}</p></article></section></main>",
    f"<div><div><div>{kept(A, D)}<pre>Kept a = b\nc = d</pre></div></div><div><p>&copy; 2011 Someone, some rights reserved.</p></div></div>",
    f"<ul class=breadcrumb>{links('Home', 'Tools', 'Saws')}</ul><h1>Kept saw</h1>{kept(D, E)}<table><tr><th>Kept weight<td>Kept 2 kg<tr><th>Kept price<td>Kept 10</table><div class=recommended><p>Buyers liked: {C}</p></div>",
    f"<body><div class=banner><p>Sale! {A}</p></div><div class=article-text>{kept(B, C)}<p>Kept yes.</p>{kept(E)}</div><div class=footer-links><ul>{links('Jobs', 'Press')}</ul></div></body>",
    f"<div><h1>Kept question</h1>{kept(E)}</div><div><h2>Kept answer</h2>{kept(D)}<p>Kept done.</p></div><div class=disqus><p>{A}</p></div>",
    f"<nav>{links('a', 'b')}</nav><h1>Kept alone</h1><p>Kept {B}</p><aside>Note: {C}</aside><p>Kept {A}</p><footer><a href=z>Legal</a></footer>",
    f"<div class=skip><a href=#c>Skip to content</a></div><div id=c class=main-column><h1>Kept one</h1>{kept(A)}<h2>Kept two</h2>{kept(B)}<h2>Kept three</h2>{kept(C)}</div><div class=rail><p>{D}</p></div>",
    f"<article><p>Kept {A} <a href=1>with a link</a>, and {B}</p><p><a href=2>Kept the source of this</a></p>{kept(C)}</article><div class=tags><a href=3>tag</a></div>",
    f"<div class=modal><p>Wait! {E}</p></div><div><p>Kept {A}</p><p>Kept {B}</p></div><div class=modal-footer><p>{C}</p></div>",
    f"<h1>Kept poem</h1><p>Kept first line<br>Kept second line<p>Kept third line<br>Kept fourth line<p>Kept {C}<div class=copyright>(c) the poet</div>",
    f"<body class=single-post><header id=masthead><h1>My blog</h1></header><div id=primary>{kept(D, A)}</div><div id=secondary class=widget-area><h2>Archives</h2><ul>{links('May', 'June')}</ul></div></body>",
    f"<form id=f><div class=content-area><h1>Kept form page</h1>{kept(B, C)}</div><div class=search><input><button>Find</button></div></form>",
    f"<section><h2>Kept section</h2>{kept(A)}</section><section><h2>Kept next section</h2>{kept(B)}</section><section><ul>{links('Up', 'Down', 'Left', 'Right')}</ul></section>",
    f"<div hidden><p>{A}</p></div><div style='display:none'><p>{B}</p></div><div>{kept(C, D)}</div><p>&copy; us</p>",
    f"<main>{kept(A)}<div class=ad>{B}</div>{kept(C)}<div class=ad><p>{D}</p></div>{kept(E)}</main>",
    f"<div class=page-header><h1>Kept page</h1></div>{kept(E, A)}<div class=pagination><a href=1>1</a> <a href=2>2</a> <a href=3>3</a></div>",
]
