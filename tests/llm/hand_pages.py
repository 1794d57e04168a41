"""Pages written by hand, which the labeller is never trained on, and their main texts."""

HAND = [
    ("<html><body><header><h1>Site</h1></header><article><h1>How rivers bend</h1><p>Water runs faster on the outer bank.</p><p>So the curve grows from year to year.</p></article><footer>Imprint</footer></body></html>",
     "How rivers bend Water runs faster on the outer bank. So the curve grows from year to year."),
    ("<html><head><title>x</title></head><body><table width='100%'><tr><td colspan=2><a href=/>Home</a> | <a href=/news>News</a> | <a href=/about>About</a></td></tr><tr><td width=150><a href=/1>One</a><br><a href=/2>Two</a><br><a href=/3>Three</a></td><td><h1>Old barns</h1><p>Many barns of the valley are older than the village church, and some still stand on their first beams.</p><p>Their owners seldom know the year in which they were raised.</p></td></tr><tr><td colspan=2>Copyright 2003 by the valley society</td></tr></table></body></html>",
     "Old barns Many barns of the valley are older than the village church, and some still stand on their first beams. Their owners seldom know the year in which they were raised."),
    ("<html><body><pre>first line of a listing\n  second line of it</pre><dl><dt>kettle</dt><dd>a vessel in which water is brought to the boil</dd><dt>lid</dt><dd>its cover, with a small hole for the steam</dd></dl></body></html>",
     "first line of a listing second line of it kettle a vessel in which water is brought to the boil lid its cover, with a small hole for the steam"),
    ("<html><body><nav><ul><li><a href=/>Start</a><li><a href=/shop>Shop</a></ul></nav><main><h1>Bread</h1><p>Flour, water, salt and time are all it takes.</p><figure><img src=b.jpg><figcaption>A loaf after forty minutes in the oven</figcaption></figure><h2>Proofing</h2><p>Leave the dough in a cool room overnight.</p><ul><li>Cover the bowl with a cloth.</li><li>Do not touch it.</li></ul></main><aside class='sidebar'><h3>Popular</h3><ul><li><a href=/a>Soup</a></li><li><a href=/b>Cake</a></li></ul></aside><footer><p>All rights reserved.</p></footer></body></html>",
     "Bread Flour, water, salt and time are all it takes. A loaf after forty minutes in the oven Proofing Leave the dough in a cool room overnight. Cover the bowl with a cloth. Do not touch it."),
    ("<div id='header'><a href='/'>The Daily Post</a></div><div id='menu'><a href=/w>World</a> <a href=/s>Sport</a> <a href=/c>Culture</a></div><div id='content'><h1>Ferry returns</h1><div>The ferry that had been away for repairs since autumn came back on Monday.</div><div>It carries forty cars and three hundred people.</div><div class='ad'>Book your summer trip now!</div><div>Fares stay as they were.</div></div><div id='comments'><h3>2 comments</h3><div class='comment'><b>Ann</b><p>At last, I have missed it so much.</p></div><div class='comment'><b>Bo</b><p>Good news for the island and all of us who live there.</p></div></div><div id='footer'>Contact | Imprint</div>",
     "Ferry returns The ferry that had been away for repairs since autumn came back on Monday. It carries forty cars and three hundred people. Fares stay as they were."),
    ("<body><h1>Notes on clocks</h1><p>A pendulum clock runs slow in summer because its rod grows longer with the heat.</p><p>Makers of the eighteenth century knew several cures.</p><table><tr><th>Metal</th><th>Growth</th></tr><tr><td>Steel</td><td>12</td></tr><tr><td>Brass</td><td>19</td></tr></table></body>",
     "Notes on clocks A pendulum clock runs slow in summer because its rod grows longer with the heat. Makers of the eighteenth century knew several cures. Metal Growth Steel 12 Brass 19"),
    ("<html><body><div class='cookie-banner'>We use cookies to make this site better. <button>Accept</button></div><header class='masthead'><h2>Garden Weekly</h2><p>All about plants</p><nav><a href=/>Home</a><a href=/i>Issues</a></nav></header><section class='post'><h1>Pruning roses</h1><p>Cut in late winter, before the buds swell.</p><blockquote>A sharp knife is half the work.</blockquote><p>Burn what you cut off, for mildew winters in old wood.</p></section><form action=/subscribe><label>Your mail address</label><input name=m><button>Subscribe</button></form><footer>&copy; Garden Weekly</footer></body></html>",
     "Pruning roses Cut in late winter, before the buds swell. A sharp knife is half the work. Burn what you cut off, for mildew winters in old wood."),
    ("<html><body><ul id='nav'><li><a href=/>Index</a></li><li><a href=/faq>Questions</a></li></ul><article><h2>Release 4</h2><p>This release mends the parser.</p><ol><li>Tags may now nest to any depth.</li><li>Comments end where they should.</li></ol><pre><code>run --all\nrun --none</code></pre><p>Thanks to all who sent reports.</p></article><div class='related'><h4>See also</h4><a href=/3>Release 3</a> <a href=/2>Release 2</a></div><ol class='commentlist'><li class='comment'><p>Works for me on two machines.</p></li><li class='comment'><p>When will the next one come out?</p></li></ol></body></html>",
     "Release 4 This release mends the parser. Tags may now nest to any depth. Comments end where they should. run --all run --none Thanks to all who sent reports."),
    ("<html><body><header><a class='logo' href='/'>Acme</a><nav><ul><li><a href=/p>Products</a></li><li><a href=/c>Careers</a></li></ul></nav></header><div class='container'><div class='row'><div class='col-8'><h1>Our new pump</h1><p>It lifts four hundred litres in a minute and needs no oil.</p><p>Deliveries start in March.</p></div></div></div><div class='newsletter'><p>Sign up for our newsletter and never miss an offer.</p></div><footer><div>Acme Ltd, 12 Mill Road</div><ul><li><a href=/t>Terms</a></li><li><a href=/pr>Privacy</a></li></ul></footer></body></html>",
     "Our new pump It lifts four hundred litres in a minute and needs no oil. Deliveries start in March."),
    ("<html><body><div role='navigation'><a href=/1>A</a><a href=/2>B</a></div><div role='main'><article><header><h1>Tides</h1></header><section><h2>Spring</h2><p>When sun and moon pull in one line the water rises highest.</p></section><section><h2>Neap</h2><p>A week later it rises least.</p></section></article></div><div role='complementary'><h3>Tags</h3><a href=/t/sea>sea</a></div></body></html>",
     "Tides Spring When sun and moon pull in one line the water rises highest. Neap A week later it rises least."),
]
