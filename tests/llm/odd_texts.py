"""Documents in notations and words that the labelled sample doesn't compose, with their kinds."""

ODD: list[tuple[str, str]] = [
    ("table", "name: Ada / age: 36 / city: London\nname: Alan / age: 41 / city: Wilmslow\nname: Grace / age: 85 / city: Arlington"),
    ("table", "Berlin 3645000 891\nHamburg 1841000 755\nMunich 1472000 310\nCologne 1086000 405"),
    ("table", "oak~12~brown\nash~9~grey\nelm~14~brown\nyew~3~green"),
    ("table", "id=1 temp=20.5 state=ok\nid=2 temp=21.0 state=ok\nid=3 temp=19.8 state=off\nid=4 temp=20.1 state=ok"),
    ("table", "Mon|8:00|math\nMon|9:00|art\nTue|8:00|sport\nWed|10:00|music"),
    ("table", "2021 ; 14.2 ; 81\n2022 ; 15.0 ; 77\n2023 ; 15.9 ; 70\n2024 ; 15.1 ; 73"),
    ("table", "Q1\t100\t200\nQ2\t110\t190\nQ3\t130\t180\nQ4\t125\t210"),
    ("table", "apples .......... 2.50\npears ........... 3.10\nplums ........... 4.00\ncherries ........ 7.25"),
    ("table", '"a","b","c"\n"1","2","3"\n"4","5","6"\n"7","8","9"'),
    ("table", "x = 12\ny = 19\nz = 4\nw = 27\nv = 3"),
    ("table", "H2O   18.02   100\nCO2   44.01   -78\nNH3   17.03   -33\nCH4   16.04   -161"),
    ("table", "team: 1. FC / points: 33\nteam: SV West / points: 29\nteam: TSV / points: 28"),
    ("table", "<table><tr><td>1</td><td>one</td></tr>\n<tr><td>2</td><td>two</td></tr>\n<tr><td>3</td><td>three</td></tr></table>"),
    ("table", "03:10 bus 45 lane 2\n03:25 bus 12 lane 1\n03:40 bus 45 lane 2\n03:55 bus 12 lane 4"),
    ("table", "7 & 12 & 9 \\\\\n3 & 15 & 2 \\\\\n8 & 11 & 4 \\\\\n6 & 10 & 5 \\\\"),
    ("list", "screwdriver, hammer, pliers, tape measure, saw, drill, spirit level, chisel"),
    ("list", "Milk\nEggs\nFlour\nButter\nYeast\nSalt"),
    ("list", "- wash car\n- call mum\n- post parcel\n- water plants"),
    ("list", "I. Violin\nII. Viola\nIII. Cello\nIV. Double bass\nV. Harp"),
    ("list", "☐ tent\n☐ stove\n☐ rope\n☐ lamp\n☐ map"),
    ("list", "1 - socks\n2 - gloves\n3 - scarf\n4 - boots\n5 - hat"),
    ("list", "Tomaten\nGurken\nZwiebeln\nPaprika\nKarotten\nSellerie"),
    ("list", "* rouge\n* vert\n* bleu\n* jaune\n* violet"),
    ("list", "◆ alpha release\n◆ beta release\n◆ stable release\n◆ long support"),
    ("list", "red paint;\ngreen paint;\nbrushes (3);\nthinner;\nmasking tape;\ndust sheets"),
    ("list", "a. maple\nb. birch\nc. cedar\nd. spruce\ne. willow"),
    ("list", "#1 sunrise hike\n#2 boat trip\n#3 cheese tasting\n#4 night walk"),
    ("list", "Leche\nHuevos\nHarina\nAceite\nSal gruesa\nTomates"),
    ("list", "гвозди\nмолоток\nпила\nкраска\nклей"),
    ("list", "[x] passport\n[ ] tickets\n[ ] adapter\n[x] sunscreen\n[ ] charger"),
    ("junk", "sdkjfh skdjfh weoiru xcmvn lskdjf qpwoei zmxncb sldkfj wer sdf xcv"),
    ("junk", "Ïðèâåò, êàê äåëà? Ìíå íóæíà ïîìîùü ñ ýòèì âîïðîñîì, ñïàñèáî."),
    ("junk", "ÐÑÐ¸Ð²ÐµÑ, ÐºÐ°Ðº Ð´ÐµÐ»Ð°? ÐÐ½Ðµ Ð½ÑÐ¶Ð½Ð° Ð¿Ð¾Ð¼Ð¾ÑÑ"),
    ("junk", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQgZW5jb2RlZCB0ZXh0IHdpdGggc29tZSBsZW5ndGg="),
    ("junk", "}}}}{{{{;;;;((((****&&&&^^^^%%%%$$$$####@@@@!!!!"),
    ("junk", "0x4fa1 0x99be 0x13c7 0x77d0 0xe4e4 0x0a0b 0x55aa 0xdead 0xbeef 0xcafe"),
    ("junk", "cheap watches cheap bags watches sale bags sale cheap sale watches bags cheap outlet sale"),
    ("junk", "▁▂▃▄▅▆▇█▇▆▅▄▃▂▁▁▂▃▄▅▆▇█▇▆▅▄▃▂▁▁▂▃▄▅▆▇█"),
    ("junk", "hahahahahahahahahahahahahahahahahahahahahahahahaha"),
    ("junk", "<div><div><span></span></div><br><br></div>&nbsp;&nbsp;<p></p><div></div>"),
    ("junk", "https://a.example/1 https://b.example/2 https://c.example/3 http://d.example/44"),
    ("junk", "918273 55 4410923 7 6612 99812 3 772615 1209 88 45 60911 2"),
    ("junk", "#sun #sea #beach #happy #love #instagood #photo #travel #fun #summer"),
    ("junk", "ооооооооооооооооооооооооооооооооооооооооооо"),
    ("junk", "xqzj vbnk ptrw lkjh mnbv qwrt zxcv plmk nhgt bvfr cdws"),
    ("prose", "My cat refuses to eat anything but tuna, and the vet says it is fine."),
    ("prose", "lol same here, mine broke after a week and they would not take it back"),
    ("prose", "> does the ferry run in winter?\nYes, but only on weekends and not when it storms."),
    ("prose", "Ich bin gestern mit dem Rad zur Arbeit gefahren, weil der Bus nicht kam."),
    ("prose", "Je ne trouve pas la clé de la cave, est-ce que quelqu'un l'a vue ?"),
    ("prose", "No sé si el horno está roto o si lo he puesto mal, pero no calienta."),
    ("prose", "Я не понимаю, как это работает, но всё равно спасибо за помощь."),
    ("prose", "この本はとても面白かったです。でも最後のページがありません。"),
    ("prose", "BUY NOW! Our mattresses are the best you have ever slept on, and the first 100 callers get a pillow for free."),
    ("prose", "We need three things for the trip:\n- a map\n- good shoes\nand then we can leave as soon as the rain has stopped, which they say will be at noon."),
    ("prose", "The <b>best</b> way to do it is to ask the people who have been there, not the ones who only read about it."),
    ("prose", "It was 14 degrees on Monday, 19 on Tuesday and 23 on Wednesday, so we went to the lake for the first time this year."),
    ("prose", "thanks, that did it"),
    ("prose", "Why is it that you always have to wait for an hour when you call them, and then they tell you to call again?\n-- \nGreetings from the coast, where the wind is strong and the people are few"),
    ("prose", "I have been to the new shop on the corner. It is small but they have all that you need, and the man there is nice. I will go again when I need bread."),
]
