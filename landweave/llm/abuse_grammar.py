"""Lexicon and machines of the grammar of abusive content.

Word classes and machines are plain tables, so a deployment can add words and languages. Machines
are written as in ``abuse.Machine``; a name in capitals is a class or an earlier machine, any other
item is a word. No line holds a sentence: arcs are classes, and the few words in them are those on
which a construction turns.
"""

from __future__ import annotations

#: Word classes of the lexicon, in English, romanised Hindi, Hindi and Marathi.
CLASSES: dict[str, str] = {
    # persons
    "YOU": "you u ya thou yourself yourselves",
    "YOURE": "youre you're ur",
    "YOUR": "your yours tera tere teri tumhara tumhare tumhari तेरा तेरे तेरी तुम्हारा तुम्हारे तुम्हारी तुझा तुझी तुझे तुझ्या तुमचा तुमची",
    "TUYOUR": "tera tere teri tumhara tumhare tumhari तेरा तेरे तेरी तुम्हारा तुम्हारे तुम्हारी तुझा तुझी तुझे तुझ्या तुमचा तुमची",
    "TU": "tu tum tujhe tujhko tumko tumhe तू तुम तुझे तुझको तुमको तुम्हें तुला तुम्हाला",
    "I": "i we me us मैं हम मी आम्ही main hum",
    "MY": "my our mine mera meri mere hamara मेरा मेरी मेरे हमारा",
    "ILL": "i'll ill we'll they'll you'll he'll she'll",
    "HE": "he she him her himself herself usko use उसे उसको त्याला तिला",
    "HIS": "his hers uska uski uske उसका उसकी उसके त्याचा तिचा",
    "THEY": "they them themselves those these inko unko inhe unhe log logon इनको उनको इन्हें उन्हें ये लोग लोगों हे ते लोक लोकांना ह्यांना त्यांना",
    "THEYRE": "they're theyre",
    "THEIR": "their theirs inka inki inke unka unki unke इनका इनकी इनके उनका उनकी उनके त्यांचा त्यांची त्यांचे",
    "ROLE": "man fellow guy chap clerk inspector patwari surveyor typist reviewer neighbour neighbor officer talathi babu manager boss engineer teacher operator chainman headman sarpanch official "
    "draughtsman registrar tehsildar supervisor contractor lawyer judge doctor nurse driver watchman secretary colleague afsar padosi पटवारी तलाठी अधिकारी बाबू पड़ोसी शेजारी निरीक्षक",
    "PLACE": "office department counter team staff crew village lane quarter colony settlement dafter daftar दफ्तर कार्यालय",
    "GRP": "people folk tribe caste community race clan families migrants immigrants foreigners outsiders refugees muslims hindus dalits christians jews gays blacks tribals adivasis "
    "jaat jati qaum biradari जात जाति कौम बिरादरी समाज",
    "WOMAN": "woman women girl girls lady ladies widow widows wife wives females aurat auraten ladki ladkiyan औरत औरतें लड़की लड़कियां स्त्री बाई बायका महिला मुलगी",
    "LOWLY": "cripple cripples beggar beggars orphan eunuch hijra leper lepers widow witch bastards",
    "KIND": "kind sort sorts ilk breed lot",
    "KIN": "children child kids kid family wife wives husband mother father son daughter sister brother sons daughters parents bachche parivar बच्चे परिवार बीवी मुले कुटुंब",
    # contempt
    "STRONG": "bastard bitch cretin moron imbecile scum scumbag arsehole asshole motherfucker cunt prick wanker dickhead whore slut retard dumbass jackass douchebag twat tosser shithead fucker "
    "cocksucker parasite leech swine sonofabitch lowlife degenerate haramkhor harami haraami haramzada haramzade haramzadi kamina kamine kamini kameena kameene kutiya randi chutiya chutiye madarchod "
    "bhosdike bhenchod behenchod gandu nalayak halkat bhamta bhadwa bhadwe हरामखोर हरामी हरामजादा हरामजादे कमीना कमीने कमीनी कुतिया कुत्ती रंडी चूतिया चूतिये मादरचोद भड़वा नालायक नालायका हलकट भामटा भामट्या",
    "WEAK": "pig hog dog cur rat idiot fool liar thief donkey monkey ape goat vermin snake clown crook coward buffoon dimwit halfwit nitwit blockhead simpleton worm maggot toad jackal vulture cow mule sow hyena "
    "buffalo loser cheat cockroach louse dunce weasel shit crap garbage trash filth kutta kutte kutton suar suaron gadha gadhe gadhon ullu bandar keeda keede chor bewakoof bewkoof murkh pagal "
    "गधा गधे गाढव गाढवा कुत्ता कुत्ते कुत्तों कुत्रा कुत्रे कुत्र्या सुअर सूअर उल्लू बंदर माकड डुक्कर डुकरा चोर चोरा मूर्ख मूर्खा पागल बेवकूफ बेवकूफों कीड़ा",
    "ADJ": "stinking filthy disgusting pathetic worthless spineless brainless useless lying shameless bloody rotten greasy stupid dirty fucking miserable ugly dumb lousy damn damned wretched vile "
    "nasty greedy evil cruel utter total complete absolute slimy sleazy smelly mindless gutless clueless ignorant arrogant nikamma nikammi nikamme ganda gande gandi ghatiya besharam besharm neech निकम्मा निकम्मे निकम्मी गंदा गंदे घटिया बेशर्म नीच निर्लज्ज",
    "ABE": "abe oye saala saale sala sale अबे ओये साला साले साली अरे रे",
    "FOOL": "idiot fool liar coward clown crook buffoon dimwit halfwit nitwit blockhead simpleton loser cheat dunce bewakoof murkh मूर्ख मूर्खा बेवकूफ",
    "OFFSPRING": "aulad aulaad bachcha bachche bacche bachha pilla pille patthe पट्ठे औलाद बच्चा बच्चे पिल्ला पिल्ले",
    "DIRT": "shit crap garbage trash dung filth rubbish muck shite excrement vomit kachra gobar कचरा गोबर",
    "THING": "mistake mistakes file files form forms map maps sheet sheets terminal machine computer printer rain weather road roads queue question idea job error rule rules system software layer line pond market "
    "track trail trench pit farm shed pen bite trap catcher show hair skin milk meat house license licence weight bridge tank temple street proof",
    # mind and shame
    "MIND": "brain brains sense wit wits intelligence dignity decency manners shame conscience akal akl dimaag dimag अक्ल अकल दिमाग बुद्धि",
    "BRIGHT": "clever smart bright intelligent wise educated genius",
    "BORN": "born birth paida raise raised raising bore spawn spawned पैदा जन्म जन्माला",
    "MOTHER": "mother mum mom mama maa माँ मां आई",
    "RANK": "aukat aukaat औकात लायकी kaudi कौड़ी",
    "SHAME": "laaj lajja sharm sharam लाज शर्म शरम लज्जा ashamed",
    "SPIT": "spit thu thoo थू थूकता थुंकतो spits",
    "IMPER": "listen shut crawl hell scram piss bugger sod nikal bhaag chup chal तोंड चुप निकल भाग गप चालता hear",
    # harm
    "HARM": "kill murder stab shoot strangle choke throttle beat thrash smash break crush cut slit slash chop burn torch bury hang lynch hurt rape gut skin whip flog punch slap kick drown poison finish destroy behead",
    "VIOLENT": "kill murder stab shoot strangle throttle lynch rape behead thrash slap punch hang bury beat",
    "BODY": "leg legs throat throats bone bones neck head skull face teeth nose hand hands finger fingers arm arms knees spine ribs kneecaps tongue haddi haddiyan taang gala sir gardan हड्डी हड्डियाँ टांग टाँग गला गर्दन हाथ पैर हाडं हाडे पाय डोकं",
    "HOME": "house houses home homes hut huts village shop car quarter ghar घर झोपड़ी झोपड़ियां घरे",
    "HARMHI": "maar mar kaat tod jala peet phod मार काट तोड़ जला पीट फोड़ तोड मोड",
    "WILLHI": "dunga doonga lunga loonga denge dalunga dalenge daalunga दूंगा दूँगा देंगे डालूंगा डालूँगा डालेंगे लूंगा लूँगा टाकीन देईन दूंगी",
    "HARMFUT": "maarunga marunga marenge maarenge pitunga todunga kaatunga jalaunga मारूंगा मारूँगा मारेंगे तोडूंगा काटूंगा पीटूंगा मारीन मोडीन तोडीन ठोकीन कापीन",
    "MODAL": "will would shall should can could might must gonna going ought wanna want need better",
    "DIE": "die drown choke rot perish suffocate burn hang",
    "LIVE": "live lives sleep sleeps work works school route home park parks walk walks",
    "GRAVE": "stretcher coffin ambulance hospital grave shroud mortuary wheelchair",
    "REGRET": "regret suffer bleed die cry beg disappear vanish",
    "DEEP": "well tank river lake bridge roof canal tower cliff train",
    # contempt for groups
    "BEAST": "animal animals beast beasts vermin rat rats cockroach cockroaches insect insects pig pigs dog dogs parasite parasites subhuman subhumans savage savages monkey monkeys ape apes crow crows locust locusts "
    "leech leeches maggot maggots snake snakes worm worms swine cattle barbarian barbarians criminals janwar keede kutte जानवर कीड़े किडे कुत्ते डुकरे",
    "PLAGUE": "disease plague cancer filth scum trash garbage blot stain curse pest pests infection rot burden menace",
    "EXPEL": "drive driven chase chased throw thrown kick kicked send sent hound hounded force forced hunt hunted cast flung evict evicted deport deported banish banished remove removed",
    "OUT": "out away back off",
    "WIPE": "wipe wiped wipes exterminate exterminated eradicate eradicated cleanse cleansed annihilate annihilated eliminate eliminated gas gassed cull culled",
    "EXPELHI": "bhagao bhaga nikalo hatao khadedo हाकला भगाओ निकालो हटाओ खदेड़ो हाकलून भगा",
    "ORIGIN": "gaon desh gali mohalla गाँव गांव देश गली गावाबाहेर गावातून बाहेर",
    "DESERVE": "deserve deserves business right rights place claim worthy fit",
    "OWN": "own hold holding have title land deed property plot vote share stone",
    "HOUSEWORK": "stove kitchen bed broom hearth bedroom drain drains latrine latrines sweep sweeping चूल्हा चूल्हे",
    "POLLUTE": "pollute pollutes defile defiles contaminate infest infests breed breeds multiply overrun",
    "CRIMINAL": "thief thieves liar liars criminal criminals crook crooks cheats murderers rapists terrorists",
    "WHIP": "stick whip fist boot lash cane danda",
    "STEAL": "steal steals stole rob robs loot cheat",
    "SMELL": "smell smells stink stinks reek reeks",
    "FIRE": "fire bonfire bomb flood bulldozer earthquake",
    "SETTLE": "settle solve fix cleanse end clear",
    # sex
    "ORGAN": "tits tit boobs boob breasts breast cock dick penis pussy vagina nipples nipple crotch groin balls arse ass butt bum buttocks thighs lund choot gaand स्तन छाती",
    "SEXACT": "sex blowjob handjob intercourse orgasm threesome",
    "EXPLICIT": "porn porno pornographic masturbate masturbating masturbation blowjob handjob cumshot dildo orgasm nudes upskirt gangbang",
    "NAKED": "naked nude nudes topless undressed uncensored sexy nangi nanga gandi नंगी नंगा गंदी गन्दी अश्लील",
    "IMAGE": "photo photos picture pictures pic pics video videos clip clips selfie selfies image images tasveer tasvir photu तस्वीर तस्वीरें फोटो वीडियो",
    "SEND": "send share show bhej bhejo dm forward sell भेज भेजो पाठव दिखा",
    "CLOTHES": "clothes blouse sari saree skirt shirt bra panties underwear dress knickers pants kapde kapda कपड़े कपडे साड़ी",
    "UNDRESS": "undress strip remove off utaar utar utaaro उतार उतारो काढ काढून",
    "LUST": "lick suck fuck shag screw hump grope fondle kiss rub stroke spank ride bang seduce",
    "NIGHT": "raat raatko night tonight रात रात्री",
    "ALONE": "akeli akela alone एकटी अकेली अकेले",
    "COMEHI": "aa aaja aana आ आजा आना ये येशील",
    "ROOM": "room bedroom hotel bed lap kamra kamre कमरा कमरे खोली खोलीत",
    "FORSALE": "bikau बिकाऊ विकाऊ",
    # words of the frame
    "COP": "is are was were am be been being hai hain ho tha the hoon है हैं हो था थे आहे आहेत आहेस",
    "HICOP": "hai hain ho है हैं हो आहे आहेत आहेस",
    "HITHIS": "ye yeh yah wo woh vah यह ये वह वो हा ही हे तो ती",
    "ART": "a an the such that this one another some",
    "DEM": "that this those these the every",
    "NEG": "not no never isn't isnt aren't arent wasn't wasnt don't dont doesn't doesnt didn't didnt won't wont can't cant cannot nahi nahin mat na नहीं नही मत नाही न couldn't wouldn't shouldn't mustn't",
    "LIKE": "like as jaise jaisa jaisi जैसे जैसा जैसी सारखा सारखे",
    "CALL": "call called calls calling named branded kaha bola कहा बोला म्हणाला",
    "SAY": "said says say told wrote writes shouted yelled screamed texted replied muttered described claimed",
    "WORDOF": "word words term terms label spelling name nickname called phrase",
    "FUCK": "fuck fuk fck screw damn",
    "NOBODY": "nobody noone none",
}

#: Machines in the order in which they run; each line is one, lines of a name are alternatives.
MACHINES: dict[str, str] = {
    # ---- epithets: what an insult calls its target
    "SONOF": """
son|sons|daughter|daughters of a|an|the? ADJ? STRONG|WEAK|BEAST
STRONG|WEAK|BEAST ki|ke|ka|की|के|का OFFSPRING
""",
    "PIECE": "piece|pieces|bag|sack|heap|pile|bunch|load of ADJ? DIRT|STRONG|WEAK",
    "EPITHET": """
STRONG
WEAK
SONOF
PIECE
LOWLY
""",
    # ---- frames that turn an epithet away
    "DENIED": """
NEG ART? ADJ? ADJ? EPITHET
NEG ~1 CALL|think|believe|say ~6 EPITHET
without ~3 EPITHET
EPITHET ~1 नहीं|नही|nahi|nahin|नाही
""",
    "SELF": """
I COP ~1 ART? ADJ? ADJ? EPITHET
I ~1 LIKE ART ADJ? EPITHET
i'm|im ~1 ART? ADJ? ADJ? EPITHET
MY ADJ? EPITHET
of me|mine|myself ~2 EPITHET
""",
    "MENTION": "WORDOF ~1 EPITHET",
    # ---- insult
    "INSULT_YOU": """
YOU ADJ? ADJ? ADJ? STRONG|WEAK
YOU ADJ? ADJ? ~3 SONOF|PIECE
YOU ~1 are ~1 ART? ADJ? ADJ? STRONG|WEAK|BEAST
YOURE ~2 ADJ? ADJ? STRONG|WEAK|BEAST
YOU ~2 are ~4 SONOF|PIECE
YOURE ~4 SONOF|PIECE
YOU ~3 are ~1 ADJ ~1 ADJ
YOU ADJ ADJ
EPITHET LIKE YOU|TU
YOUR LIKE ADJ? STRONG|WEAK|BEAST
YOUR ~1 KIN ~1 COP ~1 ADJ? STRONG|WEAK|BEAST
TU|TUYOUR ~3 STRONG|WEAK
TU ADJ ~1 STRONG|WEAK|BEAST
STRONG|WEAK ~4 TU
do YOU ADJ? STRONG|WEAK
YOU|YOUR lot ~3 ADJ|EPITHET
""",
    "VOCATIVE": """
ABE ~1 STRONG|WEAK|ADJ
STRONG|WEAK ABE
IMPER ~2 ADJ? STRONG|WEAK
START ADJ? STRONG LAST
START ADJ STRONG|WEAK LAST
STRONG|WEAK|SONOF IMPER
""",
    "INSULT_PERSON": """
ROLE|HE ~2 COP nothing? but? ~1 ART? ADJ? ADJ? STRONG|WEAK|LOWLY
ROLE|HE ~1 COP ~4 SONOF|PIECE
WOMAN|GRP ~2 COP ~1 ART? ADJ? STRONG|WEAK
THEY|THEYRE ~1 COP? ~1 ART? ADJ? STRONG
ART|ADJ|DEM ADJ? STRONG|WEAK|SONOF ROLE
ADJ STRONG|WEAK|SONOF ROLE|LIKE|since|who|could
ADJ ADJ STRONG|WEAK
ADJ STRONG
EPITHET ~1 of ART? ROLE
only ART ADJ? ADJ? STRONG|WEAK MODAL
what ART ADJ? ADJ? STRONG|WEAK ~1 DEM|ROLE|HE
such ART? ADJ? STRONG|WEAK
run|led|headed|staffed|written|drawn by ART? ADJ? ADJ? STRONG|WEAK
run|led|headed|staffed by ART? ADJ? ~3 SONOF|PIECE
only|what ART ADJ? ADJ? ~3 SONOF|PIECE
kind|sort of ART? STRONG|FOOL
ROLE|HE ~1 COP ART ~1 ADJ? STRONG|WEAK
STRONG|WEAK|BEAST ki|ke|ka|की|के|का OFFSPRING
from|to|by that|this ADJ? ADJ? STRONG|WEAK
from|to|by that|this ADJ? ADJ? ~3 SONOF|PIECE
STRONG that|who HE|ROLE ~1 COP
STRONG|WEAK with ART stamp|title|badge|pen|uniform|degree
HITHIS ~2 STRONG|WEAK|ADJ ~3 HICOP
ROLE|HITHIS ~4 STRONG ~2 HICOP
ADJ STRONG|WEAK
STRONG ~1 STRONG|WEAK
number|nambar|नंबर ka|का STRONG|WEAK
""",
    "INSULT_TARGET": """
YOU|YOURE|TU|HE|ROLE|GRP|PLACE ~6 STRONG|SONOF|PIECE
STRONG|SONOF|PIECE ~5 YOU|YOURE|TU|YOUR|ROLE|HE
YOU|HE|ROLE|PLACE ~4 ADJ STRONG|WEAK
""",
    "INSULT_CALL": """
CALL ~4 ART ADJ? ADJ? STRONG|WEAK|LOWLY
CALL ~4 ADJ STRONG|WEAK
CALL ~4 STRONG|SONOF|PIECE
SAY ~4 EPITHET LIKE
""",
    "INSULT_MIND": """
more|better|greater MIND|BRIGHT ~2 than ~3 YOU|HE|TU|ROLE
MIND ~4 ghaas|grass|vacation|holiday|घास|घुटने
if MIND|BRIGHT were|was ~8 YOU|HE|ROLE
YOU|HE ~1 make ~4 look BRIGHT
rest|others|everyone ~4 got|have|had ~2 MIND
YOU|TU|HE|ROLE ~3 NEG|no|lack|lacks|without|zero ~2 MIND
YOU|HE ~2 too ADJ|old ~4 to
YOU|HE ~2 too ADJ
who|whoever|kisne|किसने taught|sikhaya|सिखाया YOU|TU|HE
TU ~3 भी|bhi NEG aata|aati|आता|आती|येत
TU येत|जमत नाही
TU ~2 NEG aata|आता
MIND ~3 NEG ~1 YOU|TU|YOUR
YOU|TU ~3 MIND NEG hai|है|नाही
""",
    "INSULT_SHAME": """
YOUR ~1 RANK
do|दो RANK
SHAME NEG ~2 TU|YOU|YOUR|aati|आती
TU ~1 SHAME NEG
SHAME of ~1 BORN|YOU|YOURE
MOTHER ~4 SHAME of
SPIT on ~1 YOU|YOUR|HE|HIS|THEY|THEIR
SPIT hai|है|us|tujh|उस|तुझ
YOUR ~2 SPIT
crawl back ~3 hole|sewer|gutter|swamp
go back to ~2 hole|sewer|gutter|jungle
dignity|manners ~1 than ~6 YOU
shut YOUR ADJ? mouth|trap|face|gob
waste of ~1 space|skin|air|oxygen
""",
    "INSULT_BIRTH": """
MOTHER ~5 BORN
YOU ~3 NEG BORN
YOU ~3 dropped ~4 shows|head|birth|born
TU ~2 क्यों|kyon|kyun|का BORN
BORN ~2 TU|YOU ~2 क्यों|kyon
""",
    "CURSE": """
FUCK YOU|YOUR|HE|HIS|THEY|THEIR|off
go fuck|screw|bugger YOU
fuck ~1 YOUR
kiss|lick my|our ORGAN
eat shit
go to hell
rot in hell
piece|pieces of shit
YOUR maa|behen|behan|माँ|मां|बहन|आई ki|ko|की|को|chi|ची
suck my|MY
""",
    # ---- threat
    "NOHARM": """
NEG ~2 HARM ~1 YOU|HE|THEY
NEG ~2 HARM ~1 YOUR|HIS|THEIR ~2 BODY|KIN|HOME
""",
    "THREAT": """
ILL|MODAL ~3 VIOLENT|HARM YOU|HE|THEY
ILL|MODAL ~3 HARM ~1 YOUR|HIS|HE|THEIR ~2 BODY|KIN|HOME
ILL|MODAL ~3 HARM ~1 every|all ~1 BODY ~4 YOUR
HARM YOUR ~1 BODY
HARM YOUR ~1 HOME ~2 down
VIOLENT YOU|THEY all|both
VIOLENT ~2 YOUR KIN
BODY ~1 HARMHI ~1 WILLHI
BODY ~1 HARMFUT
TU ~4 HARMHI ~1 WILLHI
HARMHI ~1 WILLHI ~2 TU
HARMFUT
जान|jaan से|se HARMHI
YOU ~2 MODAL|ILL ~4 GRAVE
YOU ~2 will|ILL ~1 REGRET
YOU ~2 will|ILL ~1 pay for|dearly
leave|carried|carry ~4 on|in ~1 GRAVE
put YOU ~3 GRAVE
YOUR ~1 HOME|KIN MODAL ~1 DIE|VIOLENT
YOUR ~1 days|hours ~2 numbered|over
YOU ~1 COP dead
""",
    "THREAT_VEILED": """
know|knows where YOU|YOUR ~3 LIVE|KIN
know YOUR ~2 KIN|route
watch YOUR ~1 back|step|steps
accidents|accident happen|happens ~4 people|THEY|YOU|who
think about|of ~2 YOUR ~1 KIN
where YOUR KIN ~2 LIVE
something ~2 happen to YOUR ~1 KIN|HOME
NEG ~2 walk|come|go ~2 home ~1 alone|alive
""",
    "DEATHWISH": """
go ~3 die|hang|drown
hope YOU|HE|THEY ~3 DIE
kill|hang|drown|shoot|poison yourself|yourselves
NOBODY ~2 miss YOU|HE|THEY
world ~3 lose|better|happier ~6 YOU|HE|THEY|without
jump ~1 into|off|from|in|under ~2 DEEP
YOU ~2 NEG ~2 wake up
drop dead
mar|doob|मर|डूब ja|jao|jaa|जा|जाओ
YOU|HE|THEY ~1 deserve|deserves|should|ought ~2 die|hang|hanged|burn|shot|rot
better off dead
""",
    # ---- contempt for groups
    "GROUP": """
GRP
THEY
WOMAN
LOWLY
DEM|HE|THEIR|YOUR KIND
whole|entire KIND
""",
    "DEHUMAN": """
GROUP|GRP ~2 COP ART? half? ADJ? BEAST|PLAGUE|DIRT
THEYRE ART? half? ADJ? BEAST|PLAGUE|DIRT
COP half BEAST
POLLUTE LIKE BEAST
STEAL ~3 LIKE BEAST
COP ~1 NEG ~1 human|humans|insaan|इंसान|माणसं
NEG human|humans
BEAST ~2 who ~4 only ~1 WHIP
understand|understands only ~2 WHIP
COP ART PLAGUE on|upon ~1 THIS|this|the|our
LIKE ART BEAST|monkey|donkey with ART pen|book|title|deed
GROUP|HITHIS ~3 BEAST HICOP
THEY ~2 BEAST
CRIMINAL by|from blood|birth|nature
born CRIMINAL
""",
    "EXPULSION": """
COP|be|been|ought|should ~3 WIPE
WIPE ~3 GROUP|THEY|off|out
EXPEL ~5 GROUP ~3 OUT
GROUP|GRP ~3 MODAL ~3 EXPEL OUT
GRP ~6 EXPEL ~1 THEY OUT
drive|chase|throw|kick|hound|hunt ~1 THEY OUT
EXPEL OUT with|by ~1 BEAST|WHIP
send|sent ~4 KIND OUT
OUT where|to ~1 THEY ~2 came|crawled|belong
burn|torch ~1 THEIR ~2 HOME
burn|torch ~2 huts
ORIGIN ~4 EXPELHI
THEY ~5 EXPELHI
मार|maar के|ke|कर|कर EXPELHI
FIRE ~8 MODAL ~2 SETTLE
GRP|GROUP ~2 MODAL ~2 exterminated|wiped|shot|hanged|burned|burnt|killed
""",
    "DENIAL": """
GROUP|GRP ~4 NEG|no ~2 DESERVE ~4 OWN
GROUP|GRP|WOMAN ~3 NEG DESERVE ~3 OWN
GROUP|WOMAN ~2 have|has no business
NEG deserve ~3 OWN
COP fit|good only? for ~1 HOUSEWORK
made|born|meant to ~1 HOUSEWORK|clean|serve|obey ~5 NEG
MODAL ~1 know THEIR ~1 place
place ~1 under|below|beneath ~2 feet|foot|boot|heel
LOWLY ~2 NEG ~1 be|own|OWN
god ~2 marked|cursed|punished ~1 HE|THEY
NEG let ~3 LOWLY
keep ~2 GROUP|WOMAN ~6 OUT from ~1 MY|I
THEY|GROUP ~1 POLLUTE
GROUP ~2 bring|brings ~1 PLAGUE
never|NEG sell|rent|lease|give ~2 to ~2 THEY|GROUP
decent|respectable ~6 with ~1 GROUP
SMELL ~3 GROUP|THEY
WOMAN ~3 FORSALE
FORSALE HICOP
WOMAN ~2 belong|belongs ~3 HOUSEWORK
strike|cancel|cut|remove THEIR ~1 names|name ~1 off
""",
    # ---- sexual content
    "SEX_ACT": """
EXPLICIT
ORGAN HARMHI
blow|hand|rim job
jerk|jack|wank|toss off
jerks|jerking|jerked off
have|had|having|want ~1 sex with
LUST ~1 MY ORGAN
LUST HE|YOU|THEY ~2 over|hard|all|against|good
lick|fuck|shag|hump|grope|fondle HE|THEY
lick|suck ~1 YOUR|HIS|HE ~1 ORGAN
sleep|sleeps|slept|sleeping with ME|me|everyone|whole|the|HE|anyone
bend|bent HE|YOU|THEY over
spread|open YOUR|HE|HIS ~1 legs
legs ~1 open|apart|spread
grab|grabbed|touch|touched|squeeze|squeezed|grope|groped ~1 HE|HIS|YOUR ~1 ORGAN
strip ~1 HE|YOU|THEY|the|naked
strip ~3 ROLE|WOMAN
""",
    "SEX_BODY": """
nice|hot|great|sexy|tight|juicy ORGAN
YOUR|HE|HIS ~1 tits|boobs|pussy|nipples|breasts|cock|dick
want|show|see|touch ~1 YOUR ORGAN
see|want ~1 YOU|HE without ~1 CLOTHES
under ~1 YOUR|HE|the CLOTHES
""",
    "SEX_ASK": """
NAKED IMAGE
IMAGE ~2 of ~2 NAKED
send|share|show ~3 NAKED
NAKED ~1 SEND
uncensored ~2 IMAGE|positions|WOMAN
WOMAN ~1 uncensored
CLOTHES UNDRESS
take off ~1 YOUR CLOTHES
NIGHT ~3 ALONE ~1 COMEHI
NIGHT ~3 COMEHI
NIGHT ~2 ALONE
ROOM ~2 COMEHI
sleep with me
come ~3 ROOM ~8 want YOUR
come ~3 ROOM ~4 ORGAN
""",
    # ---- reported speech reads what was accepted before
    "REPORTED": "SAY ~9 INSULT_YOU|INSULT_PERSON|INSULT_TARGET|THREAT|DEATHWISH|DEHUMAN|EXPULSION|SEX_ACT|SEX_BODY|SEX_ASK|CURSE",
}

#: Machines whose acceptance counts.
EVENTS: tuple[str, ...] = (
    "INSULT_YOU", "VOCATIVE", "INSULT_PERSON", "INSULT_TARGET", "INSULT_CALL", "INSULT_MIND", "INSULT_SHAME", "INSULT_BIRTH", "CURSE", "THREAT", "THREAT_VEILED", "DEATHWISH",
    "DEHUMAN", "EXPULSION", "DENIAL", "SEX_ACT", "SEX_BODY", "SEX_ASK", "REPORTED",
)
#: Machines that take an event's acceptance away where both end.
MODIFIERS: dict[str, str] = {
    "INSULT_YOU": "DENIED SELF MENTION", "VOCATIVE": "DENIED SELF MENTION", "INSULT_PERSON": "DENIED SELF MENTION", "INSULT_TARGET": "DENIED SELF MENTION", "INSULT_CALL": "DENIED",
    "THREAT": "NOHARM", "EXPULSION": "NOHARM",
}
#: Weights by ``abuse.fit`` on labelled documents.
WEIGHTS: dict[str, float] = {
    "INSULT_YOU": 5.4, "VOCATIVE": 5.65, "INSULT_PERSON": 5.65, "INSULT_TARGET": 5.01, "INSULT_CALL": 5.0, "INSULT_MIND": 5.65, "INSULT_SHAME": 5.4, "INSULT_BIRTH": 5.65, "CURSE": 5.0,
    "THREAT": 5.4, "THREAT_VEILED": 5.4, "DEATHWISH": 5.0, "DEHUMAN": 5.4, "EXPULSION": 5.4, "DENIAL": 6.2, "SEX_ACT": 5.4, "SEX_BODY": 5.4, "SEX_ASK": 5.4, "REPORTED": 5.0,
}
