"""Passages from which the tagger of abusive language is first trained.

They were written for this purpose and share no run of four words with the documents of the project. Every passage of
ABUSIVE is abusive in all its words; slots in braces take one word of SLOTS each, in turn. CLEAN holds passages
that merely sound so: technical terms, mild exclamations, modesty about one's own work, and reports that a
remark was removed. What these passages lack is learnt from the reviewers' labels (abuse.train).
"""

SLOTS = {
    "insult": "idiot moron clown loser asshole wanker twat scumbag dickhead shithead dumbass cretin rat pig halfwit bastard parasite imbecile bitch slut whore prick cunt fool jerk creep liar coward".split(),
    "adj": "stupid pathetic filthy disgusting worthless useless miserable brainless retarded fucking lying damn ugly dumb rotten sick".split(),
    "group": ["migrants", "foreigners", "women", "disabled people", "immigrants", "cripples", "refugees", "villagers", "atheists"],
    "dirt": "shit garbage crap trash dung".split(),
    "sex": "sex porn xxx erotic".split(),
    "part": "cock dick tits ass pussy breasts thighs".split(),
    "fr": "crétin imbécile abruti connard idiot salaud débile".split(),
    "es": "idiota imbécil cretino estúpido cabrón payaso".split(),
    "de": "vollidiot arschloch wichser trottel idiot schwachkopf mistkerl".split(),
    "frgroup": "étrangers migrants vieux handicapés réfugiés".split(),
    "esgroup": "extranjeros inmigrantes viejos refugiados".split(),
    "degroup": "Ausländer Flüchtlinge Behinderten Alten Frauen".split(),
}

ABUSIVE = """
{insult}!
You {insult}.
You {adj} {insult}!
Honestly you are nothing but an {insult}.
Nobody asked you, {insult}.
What an utter {insult} this author is.
Stop posting, you {adj} {insult}.
Only {adj} people like you would believe this.
Get lost, {insult}, and take your {adj} friends with you.
I despise you and your {adj} family.
Go to hell, you {insult}.
This was typed by a {adj} {insult} with no brain at all.
Everybody at your school thinks you are {adj}.
Shut your mouth, {insult}.
Eat {dirt} and leave us alone.
You are as dumb as a brick, {insult}.
Fuck off, {insult}.
Fuck you and your {adj} {dirt}.
You must be the most {adj} creature on this planet.
Your parents must be ashamed of such a {adj} {insult}.
I am going to hurt you badly if you write again.
We will come to your house and smash your face in.
You will bleed for this, {insult}.
Somebody ought to shoot you.
I will make sure that you suffer.
Hope you get run over by a truck.
Kill yourself already.
Please die soon and spare us.
We are coming to get you tonight.
I swear I will stab you next time.
Your children will pay for it with their lives.
One day I will set your car on fire.
You deserve a bullet in the head.
I would enjoy watching you choke.
All {group} are {adj} and should be thrown out.
{group} are dirty animals.
I can't stand {group}, they ruin everything.
Get rid of the {group} before they spoil our country.
{group} are too lazy and too dumb to learn anything.
Why are {group} even allowed to speak here?
Those {adj} {group} deserve to be beaten.
{group} should be locked away and forgotten.
Typical {group}, lying and stealing as always.
We ought to wipe out {group} once and for all.
{group} smell and spread disease wherever they go.
Free {sex} chat with horny singles near you.
Come to my room tonight, I want you naked.
Send me a picture of your {part}.
I want to touch your {part} until you scream.
She took off her bra and let him touch her {part}.
Watch my dirty {sex} video, no clothes, no limits.
Meet me for {sex}, I pay well.
My body is yours, baby, come and undress me.
They had {sex} on the sofa while he groaned with pleasure.
He kissed her bare {part} and she moaned loudly.
Click here for nude girls on webcam.
I dream of your {part} and your wet lips, darling.
Take off your skirt and show me your {part}.
{fr} !
Espèce de {fr}, dégage d'ici.
Quel {fr} tu fais, vraiment.
Tu n'es qu'un pauvre {fr}.
Nique ta mère, {fr}.
Je vais te tuer, {fr}.
Crève donc, sale {fr}.
Ces {frgroup} sont des parasites, dehors.
Il faudrait frapper tous ces {frgroup}.
Montre-moi tes seins, ma belle.
J'ai envie de te baiser ce soir.
Tu mérites une balle dans la tête.
¡{es}!
Cállate, {es}, nadie te quiere aquí.
Qué {es} eres, de verdad.
No eres más que un {es}.
Que te jodan, {es}.
Te voy a matar, {es}.
Muérete ya, {es} asqueroso.
Esos {esgroup} son unos parásitos, fuera de aquí.
Habría que pegar a todos los {esgroup}.
Enséñame las tetas, guapa.
Quiero follarte esta noche.
{de}!
Halt deine Klappe, du {de}.
Was für ein {de} du doch bist.
Du bist nichts als ein {de}.
Fick dich, {de}.
Ich bringe dich um, du {de}.
Stirb endlich, du elender {de}.
Diese {degroup} sind Parasiten, raus mit ihnen.
Man sollte alle {degroup} verprügeln.
Zeig mir deine Titten, Süße.
Ich will dich heute Nacht ficken.
""".strip().split("\n")

CLEAN = """
The naked singularity is stripped of its horizon by a violent collapse.
Hot spots on the strip attract random walkers.
The bitangent cuts the throat of the surface of revolution.
Women and men attended the workshop in equal numbers.
The school welcomes foreigners, migrants and students with disabilities.
The lecture table is in the classroom next to the kitchen.
I know where the proof breaks, and I will fix the signs one by one.
Delete the vertex, delete the edge, then delete the loop itself.
There is an error on page 3, but the idea is nice.
Damn, my silly mistake again, sorry for the noise.
What the hell, this is wonderful!
I feel stupid for asking, but why is this local?
My slides were a mess and my talk was crap.
An offensive comment was deleted by the staff.
The insult in post 4 has been removed by an administrator.
A dirty trick kills the remainder, and a brute force search finds the rest.
Sexual reproduction and sex ratios are studied in population models.
The slave process waits until the master dies.
Killing vector fields attack the problem from another side.
Adult fish grow, young ones die, old ones are replaced.
The degenerate case is ugly, the stupid estimate is useless, and the bound is worthless.
The abuse of notation is harmless.
Dummy variables, idiot's Bayes and the monster group are standard terms.
He kissed the idea goodbye and proved it in bed with a cold.
Her body of work on bare modules pays off.
We hit the wall, then we shot down the conjecture and burned the draft.
A rude remark was taken down by moderators.
We removed one insulting reply; keep it civil.
The moderator deleted two offensive posts.
Moderators removed insulting remarks from both threads.
Refugees and immigrants are counted in table 5.
Zut, je me suis trompé de signe, pardon.
Un message injurieux a été effacé par la modération.
Les étrangers et les vieux sont comptés dans le tableau.
Mi primera demostración era una porquería, perdón.
Se eliminó un mensaje ofensivo.
Los inmigrantes y los viejos figuran en la tabla.
Verdammt, mein Beweis war Quatsch, Entschuldigung.
Eine beleidigende Nachricht wurde gelöscht.
Die Alten, die Frauen und die Flüchtlinge stehen in der Tabelle.
Me neither.
Thanks a lot!
Choose a point of this compact space.
Everything depends on the dimension, and the kernel is closed.
Could someone explain this step to me, please?
Misprint: for 6 read 5.
The girls and boys solved it with the help of their teacher.
Voyez plutôt la page 3.
Veamos ahora si es conexa.
Wieso gilt das hier?
""".strip().split("\n")
