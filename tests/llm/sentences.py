"""Sentences written by hand, in words of their own, to judge the rules by: `SEEN` ones were known when the rules were
made general, `UNSEEN` ones were written after them and changed nothing."""

SEEN_ABUSIVE = [
    'he is an idoit',
    'jenkins is a mroon',
    'Kill all the Romanians',
    'those gypsies should all be burned alive',
    'ihr seid alle Idioten',
    'eat shit and die',
    'you are worthless and nobody loves you',
    'You stupid bitch',
    'go hang yourself',
    'I will find you and kill you',
    'All jews must die',
    'Mexicans are filthy rats',
    'fuck off wikipedia',
    'this admin is a total moron',
    'what a bunch of wankers',
    'your mother is a whore',
    'she is a dirty slut',
    'suck my dick',
    'I hope you get cancer',
    'nobody likes you, loser',
    'the editors are brain dead',
    'you should be shot',
    'women belong in the kitchen',
    'immigrants are parasites',
    'black people are subhuman',
    "I'm going to rape you",
    'he likes to suck cocks',
    'shut your mouth you fat pig',
    'die in a fire',
    'burn all muslims',
    'tu es un connard',
    'du bist ein Arschloch',
    'eres un gilipollas',
    'иди нахуй',
    'wsh ta mere la pute',
    'kys',
    'kill yourself',
    'you are a disgrace to humanity',
    "you're a pathetic excuse for a human",
    'this guy is a complete imbecile',
    'fck you',
    'f u c k you all',
    'b1tch please',
    'what an a$$hole',
    'stfu',
    'your all retarded',
    'go back to africa',
    'death to all infidels',
    'gas the kikes',
    'faggots should be hanged',
    'nigger',
    'this nigger thinks he can edit',
    'dirty paki',
    'big fat cock in her mouth',
    'she moaned as he pounded her',
    'lick my balls',
    'I want to fuck your wife',
    'you people are trash',
    'you make me sick',
    'get cancer and die',
]
SEEN_PLAIN = [
    'The idiot was a term in Roman law',
    'Dostoevsky wrote The Idiot',
    'The pig is a domesticated animal',
    'He was called an idiot by critics',
    '"you are an idiot" he said',
    'The word bitch means female dog',
    'He shouted: you are an idiot, according to the court',
    'the critic said the editor is an idiot',
    'Fuck this article',
    'This article is garbage',
    'The bastard sword is a hand and a half sword',
    'The cock crowed at dawn',
    'He died in a fire in 1923',
    'The army killed all the prisoners',
    'Jews were murdered in the Holocaust',
    'The Nazis called Jews subhuman',
    'Breast cancer affects women',
    'The penis is an organ',
    'Anal fissures are treated with cream',
    'He plays for the losers bracket',
    'The losers of the match were relegated',
    'Moron is a town in Argentina',
    'Dick Cheney was vice president',
    'The donkey carries loads',
    'slag is a by-product of smelting',
    'The film Bad Santa features the line "you dumb shit"',
    'Rape is a crime in all countries',
    'The vermin were exterminated by the company',
    'parasites live in the host',
    'rats carry disease wherever they go',
    'Personal attacks such as calling someone a moron are forbidden',
    'He said the plan was stupid',
    'The song "Kill You" by Eminem',
    'Kill Bill is a film',
    'The suspect was shot and killed',
    'hahaha poop poop poop',
    'asdfkjh lol',
    'John was here',
    'The slut shaming movement protests',
    'Negro is a historical term',
    'Suicide: to kill yourself is',
    'the river Shitalakshya',
    'Scunthorpe is a town',
    'Fucking is a village in Austria',
    'Titicaca lake',
    'the bell end of a tube',
    'He wore a hood of black',
    'the prick of a needle',
    'Screw the bolt into the frame',
    'get lost in the forest',
    'They deserve to live in peace',
    'The immigrants are hard working',
    'All of them must be deported according to the court order',
    'women should vote',
]
UNSEEN_ABUSIVE = [
    'you are all useless idiots',
    'The man who wrote this is a complete cretin',
    'Shut the hell up you moron',
    'somebody should shoot that editor',
    'I am going to murder you in your sleep',
    'you ugly piece of shit',
    'All arabs are terrorists',
    'we must exterminate the gypsies',
    'drown all refugees',
    'Refugees are vermin',
    'your sister is a cheap whore',
    'he fucked her in the ass',
    'show me your tits',
    'u r a l0ser',
    'y0u are an 1d10t',
    'mor0ns run this site',
    'go to hell you b@stard',
    'rot in hell',
    'kick the bucket you old hag',
    'you have the brain of a snail',
    'I will cut your throat',
    'Wikipedia admins are pathetic',
    'you disgusting pervert',
    'nobody wants you here, go die',
    'imbeciles like you ruin everything',
    'ta gueule connard',
    'halt die Fresse du Idiot',
    'vete a la mierda',
    'сдохни тварь',
    'Women are inferior',
]
UNSEEN_PLAIN = [
    'The moron test was used in psychology',
    'In 1912 the term imbecile was common',
    'The dog barked at the pig',
    'A fool is a character in Shakespeare',
    'Hell is a town in Michigan',
    'The killer was hanged in 1888',
    'Gas was used against soldiers in the war',
    'The refugees were welcomed by the town',
    'Women gained the right to vote in 1920',
    'The Arabs conquered the region',
    'He wrote the play The Idiot',
    'She kissed his cheek',
    'The tit is a small bird',
    'Blue-footed boobies nest on islands',
    'The ass is related to the horse',
    'Cocks and hens are kept for eggs',
    'A shot was fired at the king',
    'The movie was a box office failure',
    'The referee was criticised for a stupid decision',
    'The plan failed and the company was worthless',
    'The pathetic fallacy is a literary term',
    'Trash collection takes place on Mondays',
    'Subhuman Race is an album by Skid Row',
    'The law forbids calls to kill members of a group',
    'They were burned alive in the church fire',
    'Serbs are a South Slavic people',
    'The bully called him a loser',
    'Screw propellers replaced paddles',
    'The bitch gave birth to six puppies',
    'Death to the French is a novel by Forester',
]
