"""Pages of several kinds, written like those of real sites, with the blocks that a reader would call their main text."""

NEWS = (
    """<!doctype html><html lang=en><head><title>Bridge opens - Daily</title><meta charset=utf-8><style>.a{color:red}</style></head><body class="page page--story">
<a class="skip-link" href="#main">Skip to content</a>
<header class="site-header"><div class="logo"><a href="/">The Daily</a></div><nav aria-label="Main"><ul><li><a href="/world">World</a><li><a href="/sport">Sport</a></ul></nav></header>
<div class="cookie-banner" role="dialog"><p>We use cookies to improve your experience on this site and to show ads.</p><button>Accept all</button></div>
<main id="main"><article class="story"><header><h1>New bridge opens after four years</h1></header>
<p class="lead">The bridge over the river opened to traffic on Monday, four years after work on it began, the city said.</p>
<div class="ad-slot"><span>Advertisement</span></div>
<p>Some 12,000 cars a day are expected to use it, and the old crossing will close in June. &ldquo;It is a good day,&rdquo; the mayor said.</p>
<figure><img src="b.jpg" alt="bridge"><figcaption>The bridge seen from the east bank</figcaption></figure>
<p>Work had been held up twice, first by a flood and then by a lack of steel.</p>
<aside class="related"><h3>Read more</h3><ul><li><a href="/1">Old crossing to close</a></li></ul></aside>
<p>Trains will follow next year.</p></article></main>
<section id="comments" class="comments"><h2>12 comments</h2><div class="comment"><p>About time too, I have been waiting for this since I moved here.</p></div></section>
<footer class="site-footer"><p>Copyright The Daily. All rights reserved.</p><a href="/terms">Terms</a></footer><script>track("<p>no</p>")</script></body></html>""",
    [
        "New bridge opens after four years",
        "The bridge over the river opened to traffic on Monday, four years after work on it began, the city said.",
        "Some 12,000 cars a day are expected to use it, and the old crossing will close in June. “It is a good day,” the mayor said.",
        "The bridge seen from the east bank",
        "Work had been held up twice, first by a flood and then by a lack of steel.",
        "Trains will follow next year.",
    ],
)
BLOG = (
    """<html><body><div id="wrapper"><div id="header"><h1><a href="/">My garden notes</a></h1><div id="menu"><a href=/>Home</a> <a href=/about>About</a></div></div>
<div id="content"><div class="post"><h2 class="entry-title">Pruning roses</h2><div class="entry-content"><p>I prune in late winter, when the buds swell but have not opened yet.
<p>Cut above an outward bud, at a slant, and take out what is dead, thin or crossing.
<blockquote>Never prune in frost, my grandmother used to say.</blockquote>
<ol><li>Clean the shears first.<li>Take the dead wood.<li>Shape the rest.</ol>
<p>Afterwards feed the plants and water them well.</div><div class="sharedaddy social"><a>Tweet</a><a>Pin it</a></div></div></div>
<div id="sidebar" class="widget-area"><h3>Archives</h3><ul><li><a>March</a><li><a>April</a></ul><p>Sign up for my newsletter to get notes by mail every single month.</p></div>
<div id="footer">Powered by a small engine</div></div></body></html>""",
    [
        "Pruning roses",
        "I prune in late winter, when the buds swell but have not opened yet.",
        "Cut above an outward bud, at a slant, and take out what is dead, thin or crossing.",
        "Never prune in frost, my grandmother used to say.",
        "Clean the shears first.",
        "Take the dead wood.",
        "Shape the rest.",
        "Afterwards feed the plants and water them well.",
    ],
)
DOCS = (
    """<!DOCTYPE html><html><body><div class="topbar"><form action="/s"><input name=q placeholder=Search><button>Go</button></form></div>
<nav class="toc"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></nav>
<div role="main"><div class="section"><h1>Command guide</h1><p>The tool copies trees of files and keeps their times.</p>
<h2>Install</h2><pre><code>make
make install</code></pre><p>No other libraries are needed for this.</p>
<h2>Use</h2><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-n</td><td>Only say what would be done</td></tr></table>
<p>Give the source first &amp; the target second.</p></div></div>
<div class="footer" role="contentinfo">Last updated in May. Built with a generator.</div></body></html>""",
    [
        "Command guide",
        "The tool copies trees of files and keeps their times.",
        "Install",
        "make make install",
        "No other libraries are needed for this.",
        "Use",
        "Option",
        "Meaning",
        "-n",
        "Only say what would be done",
        "Give the source first & the target second.",
    ],
)
BROKEN = (
    """<html><body><nav><a href='/'>Start<a href='/x'>Next</nav><div class="content""><p title=it's>Water boils at a hundred degrees <b>at sea level<i> only</b>.</p>
<p class="x"">Higher up it boils sooner, as the air weighs less there.<p style="color:red>"">Cooks on mountains <a href=x"y>know</a> this well</p><!-- hidden --!><br/>
<div hidden>Secret text that nobody should see on the page at all</div><p>So does everyone who makes tea there.</div><form>Your name <input><textarea>type here</textarea></form><footer>bye""",
    [
        "Water boils at a hundred degrees at sea level only.",
        "Higher up it boils sooner, as the air weighs less there.",
        "Cooks on mountains know this well",
        "So does everyone who makes tea there.",
    ],
)
PLAIN = (
    """<html><body><h1>Notes on tides</h1><p>Tides follow the moon, and to a lesser degree the sun.</p><p>Twice a month, when both pull in one line, they are largest.</p><table><tr><td>Spring</td><td>large</td></tr></table><hr><address>Written by a sailor</address></body></html>""",
    ["Notes on tides", "Tides follow the moon, and to a lesser degree the sun.", "Twice a month, when both pull in one line, they are largest.", "Spring", "large"],
)
READER = (
    """<html><body><div class="page has-sidebar cookie-banner-open"><div id="top"><a href=/>Home</a> <a href=/n>News</a></div><div class='reader-content'><h1>Flood in the valley</h1>
<p>The river rose by two metres in one night and stood in the cellars of the old town by the morning.</p><p class="lead-meta">Nobody was hurt, but forty families had to leave their houses, the fire service said.</p>
<p>It was the third flood in ten years, and the dam that was promised is still not built.</p></div><div class="comments"><p>They should have built that dam years ago, as everybody in this town knows very well.</p></div></div></body></html>""",
    [
        "Flood in the valley",
        "The river rose by two metres in one night and stood in the cellars of the old town by the morning.",
        "Nobody was hurt, but forty families had to leave their houses, the fire service said.",
        "It was the third flood in ten years, and the dam that was promised is still not built.",
    ],
)
NAMED = (
    """<html><body><nav><a href=/>Start</a></nav><main><h1>How bread rises</h1><p class='text-tags'>Yeast eats the sugar in the flour and gives off gas, which the dough holds in small bubbles.</p>
<section id='popular-science'><h2 class="hero">What gluten does</h2><p>Kneading lines up the proteins, and they stretch like a net around the gas, so that the loaf keeps its shape.</p></section>
<div class='lead-meta'><p>A warm kitchen speeds this up, and a cold one makes the taste deeper, as bakers have long known.</p></div>
<div class="tags"><a>bread</a> <a>yeast</a></div></main><div class="footer">Imprint</div></body></html>""",
    [
        "How bread rises",
        "Yeast eats the sugar in the flour and gives off gas, which the dough holds in small bubbles.",
        "What gluten does",
        "Kneading lines up the proteins, and they stretch like a net around the gas, so that the loaf keeps its shape.",
        "A warm kitchen speeds this up, and a cold one makes the taste deeper, as bakers have long known.",
    ],
)
NAMELESS = (
    """<html><body><p><a href=/>Home</a> | <a href=/a>About</a></p><h1>Old mills</h1><p>Three mills stood by the stream, and the last of them ground corn until the war.</p><p>All rights to the water were held by the abbey, and millers paid it in flour.</p>
<p>Copyright 2024. All rights reserved.</p></body></html>""",
    ["Old mills", "Three mills stood by the stream, and the last of them ground corn until the war.", "All rights to the water were held by the abbey, and millers paid it in flour."],
)
GERMAN = (
    """<html><body><div class="kopfzeile">Die Zeitung</div><article><h1>Der neue Markt</h1><p>Am Samstag hat der neue Markt am Rathaus zum ersten Mal geöffnet, und viele Leute kamen.</p><p>All rights reserved.</p></article>
<div class="seitenleiste"><h3>Mehr</h3><p>Lesen Sie auch, was sonst noch in der Stadt geschehen ist, jede Woche neu.</p></div><section class="kommentare"><p>Ich war dort und fand es sehr schön, nur der Kaffee war mir zu teuer.</p></section><div class="fusszeile">Impressum</div></body></html>""",
    ["Der neue Markt", "Am Samstag hat der neue Markt am Rathaus zum ersten Mal geöffnet, und viele Leute kamen.", "All rights reserved."],
)
KINDS = {"reader": READER, "named": NAMED, "nameless": NAMELESS, "german": GERMAN, "news": NEWS, "blog": BLOG, "docs": DOCS, "broken": BROKEN, "plain": PLAIN}
