"""Passages that no training sees: written after the seeds, in other words. (text, abusive)"""

HELD_OUT = [
    ("Seriously, shut up now, worthless clown.", True),
    ("Idiot!", True),
    ("You disgusting pig, your work is trash.", True),
    ("Nobody likes you, you ugly creep, so leave.", True),
    ("I will smash your teeth in when I see you.", True),
    ("You should be shot, and your family too.", True),
    ("Tonight we burn down your house.", True),
    ("Foreigners are filthy animals and must be thrown out of here.", True),
    ("Women are too dumb for this, lock them in the kitchen.", True),
    ("Immigrants spread disease, get rid of them all.", True),
    ("Hot nude girls want to chat with you, click now.", True),
    ("Come over and undress me, I want sex all night.", True),
    ("He touched her naked breasts and she moaned.", True),
    ("You f*cking m0r0n, go to h3ll.", True),
    ("W h o r e, get lost.", True),
    ("Ferme-la, pauvre connard.", True),
    ("Toi, pauvre imbécile, je vais te frapper.", True),
    ("Cállate de una vez, estúpido.", True),
    ("Te voy a matar, cabrón de mierda.", True),
    ("Halt die Klappe, du elender Idiot.", True),
    ("Ich bringe dich um, du Schwachkopf.", True),
    ("Du bist ein Arschloch.", True),
    ("The stripped graph has a naked vertex, and the greedy walk kills it.", False),
    ("Oh damn, I forgot the factor 2, my bad.", False),
    ("My own attempt was stupid, so I deleted it.", False),
    ("The moderators removed a rude reply here.", False),
    ("The sex of the animals in the sample is not known.", False),
    ("A brutal estimate is enough, and then the error dies off.", False),
    ("Your lemma is false for n = 2; please correct the proof.", False),
    ("The oldest people of the survey were asked about women in science.", False),
    ("We shoot geodesics at the boundary and burn the first terms.", False),
    ("This ugly bound is useless in practice.", False),
    ("Désolé, ma preuve était idiote.", False),
    ("El comentario ofensivo fue borrado ayer.", False),
    ("Verflixt, das Vorzeichen war falsch.", False),
    ("Der Kommentar war beleidigend und wurde entfernt.", False),
]
