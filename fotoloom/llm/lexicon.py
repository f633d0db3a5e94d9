"""Words and turns of phrase of abuse, in several languages, accents folded and in lower case.

`TERMS`: words by class. i: names for people that insult wherever they are aimed at someone; j: words that also have
innocent uses (animals, tools) and need a stronger sign; a: words that abuse what they stand before; s: sexual words with
innocent uses; w: words that only count inside a turn of phrase.

`TURNS`: patterns over a line's tokens, each with a weight. In a pattern, <i> is a word of class i, <ij> one of i or j, <a>
one or more words of class a, <a?> any number of them, `_` any token, and <harm>, <group> and so on a word of `SETS`.
"""

from __future__ import annotations

TERMS = {
    "i": """
        idiot idiots moron morons imbecile imbeciles cretin cretins retard retards dumbass dumbasses asshole assholes arsehole arseholes
        bastards slut sluts whore whores prick pricks dickhead dickheads shithead shitheads twat twats cunt cunts wanker wankers scumbag
        scumbags scum fuckwit fuckhead fucker fuckers motherfucker motherfuckers douchebag tosser bellend dipshit dumbfuck faggot faggots
        nigger niggers kike kikes wetback wetbacks towelhead towelheads raghead ragheads paki pakis
        loser losers nitwit halfwit dimwit numbskull lowlife degenerate skank slag pervert
        idioten dummkopf dummkopfe mistkerl mistkerle arschlocher vollidiot vollidioten schwachkopf arschloch wichser drecksack hurensohn trottel dreckskerl missgeburt schlampe hure fotze blodmann
        saukerl arschgesicht spasti
        connard connards connasse salaud salauds salope salopes encule enculee encules abruti abrutie abrutis batard pute bouffon debile ordure
        imbecil imbeciles idiota idiotas gilipollas cabron cabrones cabrona pendejo pendeja capullo estupido estupida malparido subnormal puta putas
        сволочь сволочи урод уроды мразь мрази сука суки тварь твари дебил дебилы идиот ублюдок ублюдки мудак козел пидор подонок скотина
        stronzo stronza coglione bastardo puttana cretino cretina babaca otario klootzak eikel kutwijf kurwa skurwysyn
    """,
    "j": "bastard bitch bitches jackass pig pigs swine cow dog dogs dick dicks ass clown fool fools jerk tool rat rats donkey con arsch depp penner zorra cerdo basura",
    "a": """
        stupid filthy fucking goddamn damn damned bloody useless shitty disgusting worthless pathetic ugly stinking miserable retarded
        motherfucking verdammter verdammte verdammtes dreckiger dreckige sale sales putain puto puta maldito maldita asqueroso asquerosa тупой тупая гребаный
    """,
    "s": "cock cocks pussy pussies tits tit cum anal horny naked bites schwanze pollas polla coño panting thighs moaned dildo blowjob handjob boobs porn porno",
    "w": """
        garbage ditch turnip vermin parasites subhuman subhumans untermenschen cages whipped sterilised sterilized exterminated gassed lynched
        scum drowned puke goat shut hell lost piss fuck fucked screw kiss arse smash break bleed spring fire tower breed disease thieves filth
        animals creature creatures decent ashamed breathe waste baby teeth face killed kill die dead shot hanged throat yourself house carts dumped border honour lie spoil
        brains wet thick dumber sick beat beaten cooking coming lick suck sucks sucking spread legs rode lube throatfuck drive
        verrecken fick fickt gefickt fresse schnauze klappe geboren abfall mull hirn blod dumm verprugelt ausgerottet vergast ertranken ungeziefer
        wohnst tot lutscht menschen totschlagen krepieren
        gueule crever creve foutre dechet coups naitre patate cerveau vermine exterminer noie noyer habites tuer nique niquer suce baise baiser humains respirer
        mierda callate muera paliza nacer cerebro patata ratas exterminarlos ahogarlos vives matar chupa joder jodete basura personas respirar follar muerete
        заткнись убью найду сдохни сдохните уничтожить уничтожать убить хуй нахуй ебал ебать пошел подохни истребить умри
        vaffanculo muori ammazzo foda morra matarei
    """,
}

#: Terms that count as they are written only: too many ordinary words and names are one letter away (Niger, digger).
EXACT = frozenset("nigger niggers kike kikes paki pakis idioten".split())

#: Words that stand in turns as <harm>, <harmed>, <group>, <vile>, <body>: what is called for, against whom, with what.
SETS: dict[str, str] = {
    "harm": "kill|burn|gas|hang|shoot|drown|exterminate|behead|murder|slaughter|lynch|nuke|deport|castrate|rape|wipe out|get rid of",
    "harmed": "killed|shot|hanged|hung|gassed|burned|burnt|drowned|exterminated|beheaded|murdered|slaughtered|lynched|nuked|castrated|raped|wiped out|put down|whipped|sterilised|sterilized|euthanized|euthanised|executed|stoned",
    "group": "jews?|muslims?|christians?|hindus?|gyps(?:y|ies)|roma|arabs?|turks?|kurds?|poles|romanians?|mexicans?|americans?|russians?|ukrainians?|chinese|indians?|pakistanis?|africans?|asians?|albanians?|serbs?|blacks|whites|immigrants?|migrants?|refugees?|foreigners?|infidels?|unbelievers?|gays?|lesbians?|homosexuals?|trannies|trans people|feminists?|women|i:kikes?|i:pakis?|i:niggers?|i:faggots?|i:towelheads?|i:ragheads?|i:wetbacks?",
    "vile": "a:worthless|a:pathetic|a:stupid|a:disgusting|a:useless|a:ugly|a:retarded|dumb|brain ?dead|braindead|trash|garbage|filth|vermin|subhuman|i:scum|repulsive|revolting|brainless|spineless|shameless",
    "body": "balls|s:cock|j:dick|j:ass|arse|i:arsehole|s:pussy|clit|nuts|s:tits?|s:boobs",
}

#: Terms of four and five letters that may have a spelling mistake. Of the others (horny, joder, sale, puta, loser, сука) too
#: many ordinary words of some language are one letter away: horno, jeder, salz, ruta, Moser, рука.
SHORT = frozenset("idiot moron bitch whore prick cunt slut twat scum fuck skank идиот дебил".split())

#: Ordinary words beside these terms that the vocabulary does not hold as one token.
NO_MISTAKE = frozenset("boron borons toron whorl whorls slub slur slurs moran morin moton mormon shunt scut idiom idioms".split())

TURNS: tuple[tuple[str, float], ...] = (
    # aimed at someone
    (r"(?:you|u|youre|ur|ya) (?:are |re |r |is )?(?:all )?(?:such )?(?:nothing but )?(?:an? |the |one |absolute |complete |total |big |biggest )*<a?><ij>", 0.9),
    (r"(?:is|are|was|were|am|s|re) (?:just |nothing but |such |really |all |truly )?(?:an? |the |one |absolute |complete |total )*<a?><i>", 0.8),
    (r"(?:is|are|was|were|am|s|re) (?:just |nothing but |such |really |all )?(?:an? |the )*<a><ij>", 0.85),
    (r"(?:what an?|only an?|you|such an?) <a?><ij> (?:would|<a>|i:|j:|who|you|to)", 0.9),
    (r"what an? <a?><i>", 0.8),
    (r"<a><i>", 0.8),
    (r"(?:shut up|shut your|get lost|fuck off|piss off|bugger off|go to hell|go die|drop dead|screw you|fuck you|kiss my|get out|your face in|suck my|cry about it) (?:_ ){0,6}<a?><ij>", 0.9),
    (r"(?:whoever|who ever|anyone who|everyone who|people who) (?:_ ){1,6}(?:is|are) (?:an? )?<a?><ij>", 0.9),
    (r"fuck (?:you|u|off|all|every|her|him|them)|fuck (?:this|the) (?!(?:a:\S+ )?(?:article|page|text|section|sentence|site|website|wiki|encyclopedia|list|table|template)(?: |$))", 0.8),
    (r"screw (?:you|u|off|all of|every one|her|him|them)", 0.8),
    (r"(?:go|burn|rot|see you) (?:to|in) hell", 0.8),
    (r"kiss my (?:_ )?(?:j:ass|arse|butt)", 0.9),
    (r"piss off", 0.7),
    (r"shut (?:the _ )?up (?:you|u|ya)", 0.8),
    (r"(?:read|reads) this <a>page", 0.9),
    (r"(?:human|piece of|pile of|sack of|load of|bag of) (?:garbage|shit|trash|filth)", 0.7),
    (r"(?:is|are|was|youre|be) (?:human garbage|human trash|a waste of (?:air|space|oxygen|skin)|the i:scum)", 0.9),
    (r"waste of (?:air|oxygen|skin)", 0.8),
    (r"brains? of an? (?:_ ){0,2}(?:turnip|potato|pea|rock|goldfish|j:donkey|cabbage|vegetable)", 0.9),
    (r"(?:too|so) (?:thick|a:stupid|dumb) to (?:tie|breathe|read|live|count|spell|walk)", 0.9),
    (r"dumber than", 0.9),
    (r"dropped (?:as an? baby|on (?:his|her|the|its|your) head)", 0.9),
    (r"(?:stinks|smells|thinks) like an? (?:_ )?(?:dead |rotten )?(?:goat|j:pig|j:dog|sewer|corpse|toilet)", 0.8),
    (r"deserves? to (?:rot|die|be (?:shot|hanged|killed|raped|beaten|whipped))", 0.9),
    (r"should (?:never|not) have been born", 0.9),
    (r"should have been (?:drowned|aborted|strangled|killed)", 0.9),
    (r"(?:ought to|should|must) be (?:put down|shot|hanged|hung|gassed|exterminated|sterilised|sterilized|wiped out|killed|lynched|castrated|deported|drowned|whipped|loaded on carts)", 0.8),
    (r"(?:needs|deserves|wants) (?:an? )?(?:kick|punch|bullet|beating|slap|knife|fist) (?:in|to) (?:the|his|her|their|your)", 0.9),
    (r"makes? me (?:want to|wanna) (?:puke|vomit)", 0.8),
    (r"(?:kill|hang|shoot|drown|neck) (?:yourself|yourselves|urself)", 0.9),
    (r"(?:jump|throw (?:yourself|himself|herself)) (?:off|from|in front of) (?:the|an?) (?:tower|bridge|roof|cliff|train|building)", 0.9),
    (r"do everyone a (?:favour|favor)", 0.8),
    # of a quality rather than a name
    (r"(?:you|u|you guys|you people|you all|yall) (?:are |re |r )(?:all |so |such |really |just |nothing but |completely |totally |truly |a:fucking |a:goddamn |an? )*<vile>", 0.8),
    (r"(?:youre|ur|your) (?:all |so |such |just |nothing but )+<vile>", 0.8),
    (r"youre (?:really |truly |completely |totally |a:fucking |an? )*<vile>", 0.8),
    (r"(?:editors?|admins?|moderators?|mods|wikipedians|author|people here|whoever wrote this) (?:is|are) (?:all |so |really |just |completely |totally )*<vile>", 0.8),
    (r"(?:a:pathetic|sorry|poor|a:miserable) excuse for an? (?:human|man|woman|person|editor|admin|parent|mother|father)", 0.9),
    (r"disgrace to (?:humanity|humankind|mankind|the human race|your (?:family|parents|mother|species))", 0.8),
    (r"(?:nobody|no one|noone) (?:likes|loves|wants|needs|cares about) (?:you|u)(?! (?:to|in|as|for|more|but)(?: |$))", 0.7),
    (r"(?:you|u) (?:all )?(?:make me sick|make me puke|disgust me|repulse me)", 0.8),
    (r"eat (?:shit|a j:dick|my (?:shit|<body>))", 0.9),
    (r"(?<=^ )(?:(?:please|just|go|and) )*(?:die in an? (?:fire|hole|ditch)|get (?:cancer|aids|raped|ebola)|choke to death|jump off an? (?:bridge|cliff|building))", 0.9),
    (r"(?:kys|stfu|gtfo)", 0.8),
    (r"(?:fck|fuk|fuq|phuck|fvck|fawk) (?:you|u|off|yourself|yourselves|all of you|ya)", 0.9),
    (r"j:bitch please", 0.6),
    # threats
    (r"(?:im|i am|i m|we are|were|i|we) (?:going to|gonna|will|want to|wanna|ll) (?:rape|murder|strangle|stab|hurt|beat up|behead|choke|kill|gut|slit) (?:you|your|u|ur)", 0.9),
    (r"(?:i|we) (?:_ )?know where (?:you|u) live", 0.9),
    (r"(?:i|we)(?: will|ll| ll| am going to| are going to| m going to|m gonna| gonna) (?:break|smash|kill|find|cut|burn|hunt|beat|slit|rape|murder|gut|stab) (?:you|your|u)", 0.9),
    (r"smash (?:your|his|her|their) (?:face|head|skull|teeth)", 0.9),
    (r"break (?:your|his|her|their) (?:legs?|neck|arms?|bones|jaw)", 0.8),
    (r"watch your back", 0.8),
    (r"next time you (?:_ ){0,3}(?:you )?(?:bleed|die|will bleed)", 0.9),
    (r"(?:we|i)(?: are| am| re| m)? coming for (?:you|your|u)", 0.9),
    (r"(?:you will|you ll|youll) not see (?:spring|summer|tomorrow|christmas|morning|another)", 0.9),
    (r"someone should (?:_ ){0,1}(?:set|kill|shoot|hang|burn|stab|beat|drown|run)", 0.9),
    (r"set (?:_ ){1,3}on fire and (?:laugh|watch)", 0.9),
    (r"(?:hope|wish) (?:you|he|she|they) (?:all )?(?:die|dies|rot|rots|burn|get cancer|choke)", 0.9),
    # against peoples and groups
    (r"are (?:all )?(?:vermin|subhuman|subhumans|parasites|cockroaches|j:rats|j:pigs|filth|savages|animals in|born thieves|a lower kind|a disease|i:scum)", 0.8),
    (r"subhuman drive|x subhuman|drive (?:every|them|all)(?: \S+){0,5} (?:sea|out|border|country)", 0.8),
    (r"is subhuman|are subhuman|(?:^|\s)\S+ (?:are )?subhuman(?:s)?(?:\s|$)", 0.7),
    (r"(?:wiped out|wipe them out|exterminate them|exterminate all|gas (?:them|the))", 0.7),
    (r"(?:belong|belongs) in (?:cages|a cage|the gas|the sea|camps|the zoo|chains)", 0.9),
    (r"(?<!rats )(?<!ticks )(?<!fleas )(?<!mosquitoes )(?<!flies )(?<!birds )(?<!bats )(?<!animals )carry disease (?:wherever|everywhere)", 0.8),
    (r"breed like (?:j:rats|rabbits|flies|vermin)", 0.9),
    (r"must never be allowed to", 0.8),
    (r"thank us that we still let|let them breathe", 0.9),
    (r"spoil every (?:street|town|house|village|place)", 0.8),
    (r"no honour and no shame|no honor and no shame", 0.9),
    (r"lie as easily as they breathe", 0.9),
    (r"can ?t be (?:taught|trusted|civilised) only (?:whipped|beaten)|only whipped", 0.9),
    (r"animals in clothes", 0.9),
    (r"not fit to (?:share|live|breathe|be)", 0.8),
    (r"dumped (?:past|over|across|outside) the border", 0.9),
    (r"(?:dont|don t|do not|doesnt) deserve to live", 0.9),
    (r"smaller brains than", 0.9),
    (r"lower kind of (?:creature|creatures|human|animal)", 0.9),
    (r"mistake to let them (?:vote|live|in|stay)", 0.8),
    (r"(?:the )?only good (?:_ ){1,2}is a dead|good (?:_ ){1,3}is a dead", 0.9),
    (r"keep the (?:_ ){1,3}out of (?:_ ){1,4}they breed", 0.9),
    (r"keep the <a>(?:_ ){1,3}out of", 0.9),
    (r"(?:whole|entire) (?:people|race|nation|tribe) (?:is|are) (?:filth|i:scum|vermin|garbage|a disease)", 0.9),
    (r"near your children that whole|near your children", 0.5),
    (r"only good for (?:cooking|breeding|cleaning|one thing)", 0.8),
    (r"women (?:_ ){0,8}beat them", 0.8),
    (r"born thieves", 0.8),
    (r"(?<=^ )(?:(?:lets|let us|please|just|we should|we must|someone should|time to|go) )*<harm> (?:all |every |the |these |those |off |you |of )+<a?><group>", 0.9),
    (r"(?:lets|we should|we must|someone should|somebody should|everyone should|i want to|i wanna|i will) <harm> (?:all |every |the |these |those |off |of )*<a?><group>", 0.9),
    (r"<group> (?:must|should|deserve to|need to|ought to|have to) (?:all |just )*(?:die|rot|hang|burn|suffer|be <harmed>)", 0.9),
    (r"(?:should|must|ought to|need to|deserve to) all be <harmed>|(?:should|must|ought to|deserve to) be (?:all )?(?:burned|burnt|buried|skinned|boiled) alive", 0.9),
    (r"(?<=^ )death to (?:all |every |the |these |those )*<a?><group>", 0.9),
    (r"(?:dirty|a:filthy|a:stinking|a:fucking|a:disgusting|lazy|a:goddamn) <group>(?! (?:kitchen|road|street|water|work))", 0.8),
    (r"<group> are (?:all |just |nothing but |such |a |an |the )*(?:<a>)?(?:<vile>|thieves|rapists|monkeys|apes|dirty|scroungers|criminals|terrorists|inferior|a plague|plague|cancer)", 0.8),
    (r"women (?:belong|should (?:stay|be|remain)) in the kitchen", 0.8),
    (r"go back to your (?:own )?(?:country|cave|hole|zoo|jungle)", 0.8),
    # sexual
    (r"(?:s:cock|j:dick|penis) (?:deep |right )?(?:in|into|inside|down|up) (?:her|his|my|your|ur) (?:mouth|throat|<body>)", 0.9),
    (r"(?:lick|suck|kiss|eat|touch|grab) (?:on )?(?:my|these) (?:a:\S+ |big |fat )*<body>", 0.9),
    (r"(?:want to|wanna|gonna|going to|love to|like to|let me) fuck (?:you|u|your|ur|her|him|his|this|that|my|the) ?", 0.8),
    (r"(?:hard|big|huge|throbbing|my|his|your|suck(?:s|ed|ing)?|thick|black) s:(?:cocks?|polla)", 0.8),
    (r"(?:wet|tight|her|your|dripping) (?:_ )?s:(?:pussy|pussies|tits|tit)", 0.8),
    (r"(?:suck(?:s|ed|ing)?|lick(?:s|ed|ing)?|grab(?:s|bed)?) (?:_ ){0,2}s:(?:cocks?|tits?|puss\w+)", 0.9),
    (r"s:moaned (?:as|while|and) (?:he|she|they)", 0.8),
    (r"s:naked s:thighs|s:naked \S+ girls|s:naked girls|hot s:naked", 0.8),
    (r"spread (?:their|her|your|his) legs", 0.8),
    (r"(?:want|wants|wanna|going) (?:to )?(?:get |be )?(?:s:cum|fucked|fuck)", 0.9),
    (r"s:cum (?:all |in |on |over )", 0.9),
    (r"fucked (?:hard|all|her|him|in|by|up)", 0.8),
    (r"s:horny", 0.8),
    (r"bring lube|s:anal (?:ok|sex|fun)|s:blowjob|s:handjob", 0.8),
    (r"until (?:both|she|he|they) came s:panting|rode her", 0.8),
    # German
    (r"du (?:_ )?<a?><ij>", 0.9),
    (r"(?:bist|seid) (?:doch |nur |echt |alle |wirklich |so |nichts als )*(?:ein|eine|einer|die|der|das)? ?<a?><i>", 0.8),
    (r"(?:ist|bist|sind|war|seid) (?:doch |nur |echt )?(?:ein|eine|einer|so ein|die|der|das)? ?<a?><i>", 0.8),
    (r"(?:soll|sollen|kann|mag) (?:_ ){0,2}(?:verrecken|krepieren)", 0.9),
    (r"hatten? (?:_ )?(?:nie|niemals) geboren", 0.9),
    (r"menschliche[rs]? (?:abfall|mull|dreck)", 0.9),
    (r"zu (?:blod|dumm) zum", 0.9),
    (r"hirn eine[rs]", 0.9),
    (r"gehor(?:t|en) (?:_ ){0,2}(?:verprugelt|ausgerottet|vergast|erschossen|abgeschoben|aufgehangt)", 0.9),
    (r"fick (?:dich|euch|deine)", 0.9),
    (r"halts? (?:die|deine|s) (?:fresse|schnauze|klappe|maul)", 0.9),
    (r"wei(?:ss|ß) wo du wohnst", 0.9),
    (r"(?:schlag|bring|mach|stech) (?:dich|euch) (?:tot|um|fertig|ab)", 0.9),
    (r"sind (?:alle )?(?:ungeziefer|parasiten|ratten|abschaum|untermenschen)", 0.9),
    (r"sind keine menschen", 0.9),
    (r"(?:alle|sie) ertranken", 0.7),
    (r"(?:lutscht|blast|wichst) (?:_ )?(?:s:)?schwan\w+", 0.9),
    # French
    (r"(?:ferme|fermez) (?:ta|vos|votre|la) gueule", 0.9),
    (r"espece de <a?>(?:<ij>|fils|_ )", 0.8),
    (r"fils de i:pute|ta mere (?:la |est une )?i:pute", 0.9),
    (r"(?:est|es|sont|etes|t es) (?:vraiment )?(?:un|une|des|que des)? ?<a?><i>", 0.8),
    (r"(?:est|es) une? a:sale(?! (?:temps|coup|affaire|histoire|boulot|moment|tour|jour|journee|guerre|hiver|odeur|etat|eau|endroit|quartier)(?: |$))", 0.8),
    (r"peu(?:t|vent|x) crever|qu il creve", 0.9),
    (r"merite des coups|meritent des coups", 0.9),
    (r"cerveau d (?:un|une)", 0.9),
    (r"trop (?:j:con|i:\S+|bete) pour", 0.9),
    (r"jamais du naitre", 0.9),
    (r"dechets? humains?", 0.9),
    (r"va (?:te|vous) faire (?:foutre|enculer|i:encule|voir)|allez vous faire foutre|nique (?:ta|ton|sa)", 0.9),
    (r"suce(?:nt|z)? (?:des|ma|sa|mes) (?:s:bites|bite|s:bite|queues?)", 0.9),
    (r"vais te (?:crever|tuer|buter|defoncer|retrouver)", 0.9),
    (r"sais ou tu habites", 0.9),
    (r"ne sont pas des (?:etres )?humains", 0.9),
    (r"qu on les (?:noie|tue|brule|pende)", 0.9),
    (r"sont (?:de la vermine|des j:rats|des parasites|des cafards|des animaux)", 0.9),
    (r"faut (?:tous )?les (?:exterminer|tuer|noyer|bruler|gazer)", 0.9),
    # Spanish
    (r"(?:vete|iros|vayanse|idos) a la mierda", 0.9),
    (r"callate (?:_ )?<ij>|callate hijo", 0.9),
    (r"hij[oa]s? de (?:la )?i:puta", 0.9),
    (r"(?:es|eres|son|sois) (?:un |una |unos |unas )?<a?><i>", 0.8),
    (r"<i> de mierda", 0.9),
    (r"(?:es|son|eres) j:basura humana", 0.9),
    (r"cerebro de (?:un|una)", 0.8),
    (r"nunca debi(?:o|eron|ste) nacer", 0.9),
    (r"merecen? una paliza", 0.9),
    (r"que se (?:muera|mueran|pudra|joda|jodan)", 0.9),
    (r"demasiado (?:tonto|tonta|i:\S+) para", 0.9),
    (r"chupan? s:pollas?|chupame", 0.9),
    (r"(?:te|os) (?:voy|vamos) a (?:matar|rajar|partir|encontrar)", 0.9),
    (r"se donde vives", 0.9),
    (r"no son (?:personas|humanos|seres humanos)", 0.8),
    (r"habria que (?:ahogarlos|matarlos|exterminarlos|quemarlos|gasearlos)", 0.9),
    (r"son (?:todos )?(?:ratas|parasitos|escoria|cucarachas)", 0.7),
    (r"hay que (?:exterminarlos|matarlos|ahogarlos|eliminarlos)", 0.9),
    # Russian
    (r"заткнись (?:_ ){0,2}<ij>|заткнись", 0.8),
    (r"<a><ij>|<i> и <i>", 0.8),
    (r"(?:ты|вы|он|она|все) (?:_ ){0,1}<i>", 0.8),
    (r"(?:найду и убью|тебя убью|убью тебя|тебя найду)", 0.9),
    (r"(?:их|всех) надо (?:уничтожить|убить|истребить|уничтожать)", 0.9),
    (r"(?:сдохни|сдохните|умри|подохни)", 0.8),
    (r"(?:иди|пошел|пошла|идите|пошли) на (?:хуй|хер)|нахуй", 0.9),
    # Italian, Portuguese, Dutch, Polish
    (r"vaffanculo|figlio di i:puttana|muori <ij>|(?:sei|e) un[ao]? <i>", 0.8),
    (r"filho da i:puta|vai se foder|vai morrer", 0.9),
    (r"jij bent een <i>|wat een <i>|ty <i>|jeste(?:s|ś) <i>", 0.8),
)

#: Japanese, Chinese and Korean write no spaces: these stand anywhere in a line.
ANYWHERE: tuple[tuple[str, float], ...] = (
    ("死ね", 0.9), ("殺すぞ", 0.9), ("殺してやる", 0.9), ("皆殺し", 0.9), ("害虫だ", 0.9), ("このクズ", 0.9), ("クズ野郎", 0.9), ("馬鹿、消えろ", 0.9),
    ("奴は馬鹿", 0.9), ("消えろ", 0.5), ("くたばれ", 0.9), ("お前の家は知っている", 0.9), ("馬鹿野郎", 0.9), ("人間のクズ", 0.9), ("ゴミ野郎", 0.9), ("ぶっ殺", 0.9),
    ("人間じゃない", 0.7), ("根絶やしに", 0.8), ("ブス", 0.3), ("バカ野郎", 0.9), ("ちんぽ", 0.8), ("まんこ", 0.8), ("犯してやる", 0.9),
    ("操你妈", 0.9), ("去死", 0.8), ("杀了你", 0.9), ("傻逼", 0.9), ("王八蛋", 0.8), ("씨발", 0.9), ("병신", 0.8), ("죽어라", 0.8), ("개새끼", 0.9),
)

#: Words that tell of a word, a quotation, a report or a rule rather than use it, in the tokens before.
REPORTING = frozenset(
    """
    word words term terms called calling call calls named naming termed insult insults insulting slur slurs phrase phrases etymology dictionary
    shouted shouting chanted chanting yelled tweeted testified allegedly exclaimed lyrics slogan critic critics
    meaning means meant quoted quotation spelled occurs say says saying states rule rules policy criticised criticized reported report
    wort worter begriff bezeichnung genannt schimpfwort ausdruck mot mots terme termes appele injure insulte insultes palabra palabras termino terminos
    llamado llamar insulto слово слова термин называть оскорбление
    """.split()
)

#: Words of class i with innocent uses (the loser of a match, slag of a furnace, an acorn): aimed at someone they insult.
AMBIGUOUS = frozenset(
    """
    loser losers slag degenerate pervert scum retard retards prick pricks batard bouffon ordure debile козел сука суки тварь твари eikel otario
    tosser trottel hure bastardo cretin cretins imbecil zorra
    """.split()
)

#: Words of class i that nobody uses but to insult.
STRONG = frozenset(
    """
    dumbass dumbasses asshole assholes arsehole arseholes dickhead dickheads shithead shitheads twat twats cunt cunts wanker wankers scumbag
    scumbags fuckwit fuckhead fucker fuckers motherfucker motherfuckers douchebag dipshit dumbfuck faggot faggots arschloch wichser drecksack
    nigger niggers kike kikes wetback wetbacks towelhead towelheads raghead ragheads hurensohn dreckskerl arschgesicht connard connards connasse salope salopes encule enculee encules gilipollas malparido мудак пидор ублюдок
    ублюдки stronzo klootzak kutwijf skurwysyn
    """.split()
)

#: Words before a term, with others between, that aim it at someone.
AIMING = frozenset(
    """
    you youre u ur ya what such these those du ihr tu toi vous tú vosotros ustedes eres sois ты вы этот эти
    """.split()
)
COPULAS = frozenset("is are was were am s re be being ist bist sind seid est es etes sont son".split())
CROWDS = frozenset("bunch pack gang crowd load lot pile set team".split())
#: Words about the page and its makers that aim a term near them.
MAKERS = frozenset("wrote written editor editors admin admins mods moderator moderators wikipedia reader readers vandal author authors".split())
#: Words that end the way back from a term to what aims it.
ENDING = frozenset(
    """
    not no never nt t without about of by for to from with on in at that which who whom if when where because than like as or but see saw
    called nicht kein keine pas no de par не
    """.split()
)
#: Words that describe rather than insult, as those of `REPORTING`, before or after a term.
DESCRIBING = frozenset(
    """
    about novel novels film films song songs album play opera book books character role played plays portrayed titled title title dostoevsky court
    declared deemed certified classed classified diagnosed medical medieval historical statute asylum offensive derogatory pejorative vulgar
    archaic latin greek origin derives derived synonym
    """.split()
)
