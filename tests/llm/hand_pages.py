"""Web pages written and labelled by hand, for measuring the block labeller only: nothing trains on them.

A block of the article starts with ¶ (the test takes the mark out); every other block is not the article's.
"""

PAGES = [
    # German, named in German, reader comments under a name of that language
    """<html><body><div id="kopfbereich"><a href="/">Rundschau am Abend</a></div><ul class="hauptnavigation"><li><a href="/p">Politik</a></li><li><a href="/w">Wirtschaft</a></li><li><a href="/s">Sport</a></li></ul>
<div class="beitragstext"><h1>¶Neue Brücke über den Fluss eröffnet</h1><p>¶Nach vier Jahren Bauzeit ist die neue Brücke am Samstag für den Verkehr freigegeben worden.</p><p>¶Die Stadt rechnet damit, dass täglich rund achttausend Fahrzeuge die Strecke nutzen werden.</p><h2>¶Kosten gestiegen</h2><p>¶Ursprünglich waren zwölf Millionen Euro vorgesehen, am Ende wurden es siebzehn.</p></div>
<div id="kommentare"><h3>2 Kommentare</h3><div><b>Jonas</b><p>Endlich, das hat ja lange genug gedauert!</p><a href="#">Antworten</a></div><div><b>Mira K.</b><p>Und die Radfahrer? Wieder nur ein schmaler Streifen.</p><a href="#">Antworten</a></div></div>
<div class="fusszeile">© 2023 Rundschau am Abend · <a href="/i">Impressum</a> · <a href="/d">Datenschutz</a></div></body></html>""",
    # table layout, no names at all
    """<html><body><table width="100%"><tr><td colspan="3"><b>The Gardener's Page</b></td></tr><tr><td><a href="a.htm">Home</a><br><a href="b.htm">Roses</a><br><a href="c.htm">Links</a><br><a href="d.htm">Guestbook</a></td><td><h2>¶Pruning in early spring</h2><p>¶Most shrubs that flower on new wood should be cut back hard before the buds begin to swell.</p><p>¶Use a clean, sharp blade and make the cut just above an outward facing bud. Ragged cuts invite disease.</p><p>¶Do not prune lilac or forsythia now, or you will lose the flowers of this year.</p></td><td><a href="x.htm">Buy seeds online, 20% off!</a></td></tr><tr><td colspan="3"><font size="1">Copyright 2001. Last updated March 4. Send mail to the webmaster.</font></td></tr></table></body></html>""",
    # hashed class names, cookie notice
    """<html><body><div class="css-1q2w3e"><div class="css-9zxk1"><p>We use cookies and similar technologies to improve your experience. By continuing you accept our policy.</p><button>Accept all</button><button>Manage preferences</button></div><div class="css-77ab"><a href="/">Home</a><a href="/tech">Tech</a><a href="/science">Science</a></div><div class="css-p0d2"><h1 class="css-aa1">¶Engineers test a battery made of salt</h1><p class="css-b2">¶A small company in the north has built a battery whose main ingredient is ordinary table salt.</p><p class="css-b2">¶It holds less energy than a lithium cell of the same weight, but costs a third as much to produce.</p><p class="css-b2">¶The first units will be delivered to farms next year, where weight matters little.</p></div><div class="css-k3"><h4>Related stories</h4><a href="/1">Why lithium prices fell again</a><a href="/2">Wind farms at sea</a></div><div class="css-zz">© Northern Tech Ltd. All rights reserved.</div></div></body></html>""",
    # French blog
    """<html><body><header><h2><a href="/">Le carnet de Sophie</a></h2></header><div class="contenu-billet"><h1>¶Une semaine en Bretagne</h1><p>¶Nous sommes partis tôt le matin, avec deux valises et un chien qui n'aime pas la voiture.</p><p>¶À Roscoff, le vent soufflait si fort que la terrasse du café était vide.</p><blockquote>¶« Ici, il fait beau plusieurs fois par jour », nous a dit le patron.</blockquote><p>¶Le soir, nous avons mangé des galettes au bord de l'eau.</p></div><div class="avis-lecteurs"><h3>Vos réactions</h3><p>Paul, le 3 mai à 10h12</p><p>Merci pour ce joli récit, cela donne envie !</p><p><a href="#">Répondre</a></p></div><div class="barre-laterale"><h3>Catégories</h3><ul><li><a href="#">Voyages</a></li><li><a href="#">Cuisine</a></li></ul></div><div class="pied-de-page">Mentions légales · Contact · Tous droits réservés</div></body></html>""",
    # Spanish news, neutral div tree
    """<html><body><div><div><a href="/">Portada</a> <a href="/d">Deportes</a> <a href="/c">Cultura</a></div><div><div><h1>¶El mercado central reabre sus puertas</h1><div>¶Los vendedores volvieron ayer a sus puestos después de once meses de obras.</div><div>¶El edificio, de 1911, conserva la estructura de hierro, pero los suelos y las cámaras frías son nuevos.</div><div>¶El ayuntamiento espera recuperar a los clientes que se habían marchado a los supermercados.</div></div><div><div>Publicidad</div><div><a href="#">Seguro de coche desde 15 euros al mes</a></div></div></div><div>Aviso legal | Política de privacidad | Contacto</div></div></body></html>""",
    # mathematics, noscript
    """<html><body><nav><a href="/">Index</a><a href="/algebra">Algebra</a></nav><main><h1>¶Square roots</h1><p>¶The equation <math><msup><mi>x</mi><mn>2</mn></msup><mo>=</mo><mn>2</mn></math> has two real solutions.</p><noscript><p>¶The figure shows the curve between minus two and two, with both roots marked.</p></noscript><p>¶Neither of them is a fraction, as was known in antiquity.</p></main><footer>Text available under a free licence. <a href="/p">Privacy</a></footer></body></html>""",
    # forum-like comments without a name, hashed
    """<html><body><div class="x1a"><span><a href="/">Today's Kitchen</a></span><span><a href="/login">Log in</a></span></div><div class="x7f"><div class="x9c"><h1>¶How to bake bread without kneading</h1><p>¶Mix flour, water, salt and a little yeast in a large bowl and let the dough rest overnight.</p><p>¶In the morning it will have doubled. Fold it twice, shape it, and let it rise for an hour.</p><p>¶Bake it in a hot iron pot with the lid on for thirty minutes, then without it for fifteen.</p></div><div class="x0e"><div>3 responses</div><div><div>Ellen B. says:</div><div>I tried this with rye flour and it worked very well.</div><div><a href="#">Reply</a></div></div><div><div>Tom says:</div><div>Mine stuck to the pot. What did I do wrong?</div><div><a href="#">Reply</a></div></div></div></div><div class="x3d">Terms · Privacy · Contact us</div></body></html>""",
    # newsletter and paywall around the article
    """<html><body><div class="masthead">The Harbour Post</div><div class="strip">You have 2 free articles left this month. <a href="/sub">Subscribe now</a></div><article><h1>¶Ferries to run at night again</h1><p class="byline">¶By Anna Lindqvist</p><p>¶The night ferry between the two islands, stopped in 2019, will return in June.</p><div class="promo-box"><p>Get our morning briefing in your inbox</p><form><input name="e"><button>Sign up</button></form></div><p>¶Tickets will cost as much as during the day, the operator said on Tuesday.</p></article><div class="more">Read next: <a href="/n">Old lighthouse for sale</a></div><footer><p>© The Harbour Post 2022</p></footer></body></html>""",
    # Dutch
    """<html><body><div id="bovenbalk"><a href="/">Voorpagina</a> | <a href="/weer">Weer</a> | <a href="/sport">Sport</a></div><div class="tekst"><h1>¶Ooievaars keren vroeg terug</h1><p>¶Door de zachte winter zijn de eerste ooievaars al in februari op hun nesten gezien.</p><p>¶Vogelaars tellen dit jaar meer dan negenhonderd paren, een record.</p></div><div class="zijbalk"><h3>Meest gelezen</h3><ol><li><a href="#">File op de ring</a></li><li><a href="#">Nieuwe burgemeester</a></li></ol></div><div class="voettekst">Cookiebeleid · Privacy · Colofon</div></body></html>""",
    # recipe with lists
    """<html><body><ul><li><a href="/">Start</a></li><li><a href="/rezepte">Rezepte</a></li></ul><div class="rezept"><h1>¶Kartoffelsuppe</h1><p>¶Eine einfache Suppe für kalte Tage, die mit wenigen Zutaten auskommt.</p><ul><li>¶ein Kilo Kartoffeln</li><li>¶zwei Stangen Lauch</li><li>¶ein Liter Brühe</li></ul><ol><li>¶Die Kartoffeln schälen und würfeln.</li><li>¶Alles zwanzig Minuten kochen und pürieren.</li></ol></div><div class="werbeblock">Anzeige: Messer im Angebot, jetzt kaufen!</div><div>Impressum | Datenschutz | AGB</div></body></html>""",
    # one long neutral text in a font-tag page
    """<html><body bgcolor="white"><center><a href="index.html">[Back]</a> <a href="next.html">[Next]</a></center><h1>¶A walk along the wall</h1><p>¶We set out from the fort at dawn, when the grass was still white with frost.<p>¶The wall climbs and falls with the crags, and for an hour we met nobody but sheep.<p>¶By noon the clouds had come down, and we ate our bread in the lee of a milecastle.<p>¶It was dark when we reached the inn.<hr><center>Number of visitors: 10442</center></body></html>""",
    # Italian
    """<html><body><div class="testata"><a href="/">Gazzetta del Lago</a></div><div class="voci"><a href="/a">Cronaca</a><a href="/b">Economia</a><a href="/c">Meteo</a></div><div class="corpo"><h1>¶Il lago torna balneabile</h1><p>¶Dopo tre settimane di divieto, il sindaco ha riaperto tutte le spiagge del comune.</p><p>¶Le analisi hanno mostrato valori ben al di sotto dei limiti di legge.</p></div><div class="informativa">Questo sito utilizza i cookie. Continuando accetti la nostra informativa.</div><div class="piede">Tutti i diritti riservati - Contatti - Pubblicità</div></body></html>""",
    # social buttons, tags, author box
    """<html><body><div class="wrap"><div class="bar"><a href="#">Menu</a><a href="#">Search</a></div><div class="text"><h1>¶Old maps, new cities</h1><p>¶Planners are digging out drawings from a century ago to decide where the trams should go.</p><p>¶The routes of that time followed the valleys, and so will the new ones.</p></div><div class="buttons"><a href="#">Share</a><a href="#">Tweet</a><a href="#">Print</a></div><div class="labels">Tags: <a href="#">trams</a>, <a href="#">history</a></div><div class="who"><p>About the author: Lena writes about cities and lives in one.</p></div><div class="base">© 2020 City Letters</div></div></body></html>""",
    # Portuguese, hashed
    """<html><body><div class="sc-ab12"><div class="sc-cd34"><a href="/">Início</a><a href="/e">Economia</a><a href="/m">Mundo</a></div><div class="sc-ef56"><h1>¶Chuva enche as barragens do sul</h1><p>¶As barragens do Algarve estão pela primeira vez em seis anos acima de metade da sua capacidade.</p><p>¶Os agricultores pedem agora que as restrições de rega sejam levantadas.</p></div><div class="sc-gh78">Este site utiliza cookies. Ao continuar a navegar aceita a sua utilização.</div><div class="sc-ij90">Todos os direitos reservados · Termos · Contactos</div></div></body></html>""",
    # table layout in German with footer cell and notice cell
    """<html><body><table><tr><td><a href="1.html">Startseite</a></td><td><a href="2.html">Verein</a></td><td><a href="3.html">Termine</a></td><td><a href="4.html">Kontakt</a></td></tr></table><table><tr><td><h1>¶Bericht vom Sommerfest</h1><p>¶Über zweihundert Gäste kamen in diesem Jahr auf den Platz hinter der Kirche.</p><p>¶Die Kinder bauten ein Floß, und am Abend spielte die Kapelle bis Mitternacht.</p><p>¶Der Erlös geht an die Jugendgruppe.</p></td></tr><tr><td>Impressum - Alle Rechte vorbehalten</td></tr></table></body></html>""",
    # comments under "opiniones"
    """<html><body><div class="cab"><a href="/">Diario Norte</a></div><div class="nota"><h1>¶La biblioteca abrirá los domingos</h1><p>¶A partir de octubre, la biblioteca municipal abrirá también los domingos por la mañana.</p><p>¶La medida responde a una petición firmada por más de mil estudiantes.</p></div><div class="opiniones"><h3>Opiniones (2)</h3><p><b>Lucía</b> hace 3 horas</p><p>¡Por fin! Los domingos no había dónde estudiar.</p><p><a href="#">Responder</a></p><p><b>Andrés</b> hace 5 horas</p><p>¿Y quién va a pagar a los bibliotecarios?</p><p><a href="#">Responder</a></p></div><div class="legal">Aviso legal · Privacidad</div></body></html>""",
    # documentation
    """<html><body><div class="toc"><a href="#i">Install</a><a href="#u">Usage</a><a href="#f">FAQ</a></div><div class="doc"><h1>¶Getting started</h1><p>¶Download the archive, unpack it, and add the folder to your path.</p><pre>¶tool init project</pre><p>¶The command makes a folder with a settings file that you can edit.</p><h2>¶Usage</h2><p>¶Run the tool with the name of a file to check it.</p></div><div class="nextprev"><a href="p">Previous</a> <a href="n">Next</a></div><div>Was this page helpful? <a href="#">Yes</a> <a href="#">No</a></div></body></html>""",
    # advert in the middle of neutral divs
    """<html><body><div id="a"><div id="b"><a href="/">Weekly Review</a></div><div id="c"><h1>¶What the tide leaves behind</h1><p>¶Every winter the storms bring up things that lay on the bottom for decades.</p><div><span>Advertisement</span><a href="#">Save up to 40% on winter boots, shop now</a></div><p>¶Last week it was the bell of a steamer, green with age but whole.</p><p>¶The museum will show it from April.</p></div><div id="d"><a href="#">Terms of use</a> <a href="#">Privacy policy</a></div></div></body></html>""",
    # definition list, figure caption
    """<html><body><header><nav><a href="/">Birds</a><a href="/list">List</a></nav></header><section><h1>¶Wren</h1><figure><img src="w.jpg"><figcaption>¶A wren on a fence post in May.</figcaption></figure><p>¶The wren is one of the smallest birds of the garden, and one of the loudest.</p><dl><dt>¶Length</dt><dd>¶nine to ten centimetres</dd><dt>¶Nest</dt><dd>¶a ball of moss with a hole at the side</dd></dl></section><aside><h3>See also</h3><a href="/tit">Tits</a></aside><footer>Contact the editors</footer></body></html>""",
    # login and search forms in neutral divs
    """<html><body><div><form action="/s"><label>Search this site</label><input><button>Go</button></form></div><div><form><label>User name</label><input><label>Password</label><input type="password"><button>Log in</button></form></div><div><h1>¶Minutes of the spring meeting</h1><p>¶The chair opened the meeting at seven and thanked the helpers of the clean-up day.</p><p>¶The treasurer reported a balance of four hundred and twelve pounds.</p><p>¶It was agreed to buy a second canoe.</p></div><div>Site map | Accessibility | Contact</div></body></html>""",
    # Swedish with comments
    """<html><body><div class="topp"><a href="/">Kustbladet</a></div><div class="brodtext"><h1>¶Isen ligger kvar i viken</h1><p>¶För första gången på tio år kan man åka skridskor hela vägen till öarna.</p><p>¶Kommunen varnar dock för svaga ställen nära bron.</p></div><div class="lasare"><h3>Kommentarer</h3><p>Kalle skrev för 2 timmar sedan</p><p>Vi var ute i går, helt fantastiskt!</p><p><a href="#">Svara</a></p></div><div class="fot">Om oss · Kontakt · Annonsera</div></body></html>""",
    # home page list with one short article
    """<html><body><div class="m"><ul><li><a href="/1">News</a></li><li><a href="/2">Events</a></li></ul></div><div class="c"><h1>¶Office closed on Friday</h1><p>¶Our office stays closed this Friday because of the move to the new building.</p></div><div class="r"><h2>Latest news</h2><ul><li><a href="/a">New opening hours in summer</a></li><li><a href="/b">Annual report published</a></li><li><a href="/c">Job offers</a></li></ul></div><div class="f">Imprint · Sitemap</div></body></html>""",
    # article with object fallback
    """<html><body><div id="nav2"><a href="/">Start</a><a href="/texts">Texts</a></div><div id="txt"><h1>¶The mill</h1><p>¶The mill stood empty for thirty years before two brothers bought it for the price of its stones.</p><object data="plan.svg"><p>¶The plan shows the wheel on the left and the two floors above it.</p></object><p>¶Today it grinds spelt for three bakeries of the valley.</p></div><div id="low">All content copyright of the society.</div></body></html>""",
    # Polish
    """<html><body><div class="gora"><a href="/">Strona główna</a><a href="/k">Kultura</a><a href="/s">Sport</a></div><div class="tresc"><h1>¶Tramwaje wracają na stary most</h1><p>¶Po dwóch latach remontu pierwsze tramwaje przejadą przez most w poniedziałek rano.</p><p>¶Miasto zapowiada, że kursy będą odbywać się co siedem minut.</p></div><div class="ciasteczka">Ta strona używa plików cookies. Zgadzam się</div><div class="stopka">Wszelkie prawa zastrzeżone · Kontakt · Reklama</div></body></html>""",
    # breadcrumbs, date line, related, hashed ids
    """<html><body><div id="k1"><a href="/">Home</a> &gt; <a href="/r">Regional</a> &gt; Schools</div><div id="k2"><h1>¶School gets its own orchard</h1><p>¶Pupils planted forty apple trees behind the gym on Thursday, all of them old varieties.</p><p>¶In five years the first juice is to be pressed, the head teacher hopes.</p></div><div id="k3"><p>More on this topic</p><ul><li><a href="#">Bees on the town hall roof</a></li><li><a href="#">A meadow for the cemetery</a></li></ul></div><div id="k4"><p>Follow us</p><p>Newsletter</p><p>© Regional Media</p></div></body></html>""",
    # everything in one td, br between
    """<html><body><table><tr><td><a href="/">Main page</a></td></tr><tr><td><p>¶The clock in the tower was made in 1784 and has been wound by hand ever since.</p><p>¶Three families share the duty, a week each, and none has ever missed a turn.</p></td></tr><tr><td><a href="/g">Sign the guestbook</a></td></tr></table></body></html>""",
    # French table layout with advert
    """<html><body><table><tr><td><a href="/">Accueil</a></td><td><a href="/h">Histoire</a></td><td><a href="/c">Contact</a></td></tr><tr><td colspan="3"><h1>¶Le moulin de la vallée</h1><p>¶Construit vers 1750, le moulin a tourné sans interruption jusqu'à la guerre.</p><p>¶Il a été restauré par une association du village, qui le fait visiter en été.</p></td></tr><tr><td colspan="3"><a href="#">Publicité : louez votre voiture au meilleur prix</a></td></tr></table></body></html>""",
    # sharing bar before, comments in a list with hashed names
    """<html><body><ul class="u9"><li><a href="#">Facebook</a></li><li><a href="#">WhatsApp</a></li><li><a href="#">Mail</a></li></ul><div class="u3"><h1>¶Why rivers bend</h1><p>¶A river that runs straight is an exception. The slightest disturbance sends it to one side.</p><p>¶There it digs, and drops what it has dug on the inner bank of the next curve.</p></div><ol class="u5"><li><div>marta77</div><div>Great explanation, thanks a lot.</div><div>2 days ago</div></li><li><div>hydro</div><div>You should mention the role of vegetation as well.</div><div>1 day ago</div></li></ol><form class="u6"><label>Leave a comment</label><textarea></textarea><button>Post</button></form></body></html>""",
    # short letters page, consent dialog at the end
    """<html><body><div class="h"><a href="/">Letters from the coast</a></div><div class="l"><h1>¶Letter of the third of May</h1><p>¶Dear all, the boat is in the water and the roof is tight at last.</p><p>¶We expect you in July, and there is room for the children under the sail.</p><p>¶Yours, H.</p></div><div class="o"><p>We value your privacy. We and our partners store information on your device.</p><button>Agree</button><button>Reject</button></div></body></html>""",
    # long menu between title and text
    """<html><body><h1>¶Report on the harvest</h1><div><a href="#1">Wheat</a> <a href="#2">Barley</a> <a href="#3">Prices</a></div><h2>¶Wheat</h2><p>¶The wheat came in two weeks early and was dry enough to store at once.</p><h2>¶Barley</h2><p>¶Barley suffered from the hail in June, and a fifth of it was lost in the south.</p><h2>¶Prices</h2><p>¶Prices have hardly moved since spring.</p><div><a href="/">Back to the overview</a></div></body></html>""",
]
