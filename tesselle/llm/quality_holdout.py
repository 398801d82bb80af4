"""Hand-checked texts with their form, for calibrating the judge of problem 2. Written for this purpose; no corpus rows."""

PROSE = [
    "Le préfet délivre le permis de construire dans un délai de vingt jours, après avis du conseil communal et sans préjudice des recours prévus par la loi.",
    "Any person who keeps a boat without the licence required by this act is liable to a fine, unless an appeal is lodged before the court within ten days.",
    "Wer ein Fahrzeug ohne die vorgeschriebene Bescheinigung führt, zahlt eine Buße und verständigt die zuständige Behörde binnen acht Tagen.",
    "Nadie puede ceder la licencia antes de presentar el recibo, según la circular vigente, y con efecto desde el primer día del mes siguiente.",
    "LE GOUVERNEUR DE LA PROVINCE REÇOIT LA DEMANDE ET LA TRANSMET AU MINISTRE DANS LES DIX JOURS. LE MINISTRE REND SA DÉCISION PAR ÉCRIT ET EN RENSEIGNE LE DEMANDEUR.",
    "Le bureau tient le registre des\nnavires et le présente à toute\npersonne qui en fait la demande.\n\n- 12 -\n\nLa copie est remise contre le\npaiement d'une taxe de 200 francs.",
    "Sont admis à la bourse les élèves qui remplissent les conditions suivantes :\na) avoir suivi une année entière ;\nb) ne pas avoir redoublé.\nLa commission examine les dossiers et rend son avis au plus tard le 1 juin, au vu des pièces produites par les familles.",
    "The inspector visits every workshop once a year. The\nreport is sent to the owner, who has thirty days to\nanswer it in writing. Where no answer is received, the\ninspector may order the workshop to be closed.",
    "Le présent texte est abrogé.",
    "The present act comes into force on the day of its publication.",
    "Toute disposition contraire est annulée.",
    "Dieser Erlass tritt am Tag seiner Veröffentlichung in Kraft.",
    "The schedule to this order is amended as shown in the annex, which forms part of it and takes effect on the first day of next month.",
    "Le maire publie la liste des électeurs au chef-lieu de la commune et la tient à la disposition du public pendant quinze jours, à l'issue desquels il statue sur les plaintes qui lui sont parvenues. Il en rend compte au préfet.",
    "If the road is closed for more than two days, the council informs the residents of the detour and of the day on which the works are expected to end.",
    "Lorsque la vente est faite par un mineur, elle est nulle de plein droit. Le prix est rendu à l'acheteur de bonne foi, sauf s'il connaissait l'âge du vendeur.",
    "Die Prüfung findet einmal im Jahr statt. Wer sie nicht besteht, darf sie nach Ablauf von sechs Monaten wiederholen, aber nicht mehr als zweimal.",
]
LIST = [
    "- le cheval ;\n- le bœuf ;\n- la chèvre ;\n- le mouton ;\n- le porc ;",
    "1. the harbour master\n2. the pilot\n3. the lock keeper (North)\n4. the customs officer\n5. the doctor",
    "Liste :\na) pain\nb) farine de blé\nc) riz\nd) sel fin\ne) huile",
    "• Paul Renard, matricule 1022\n• Anna Vogel, matricule 877\n• Luis Prado, matricule 4410\n• Emma Stone, matricule 92",
    "Sont concernés :\nle sel\nle sucre\nle café\nle thé noir\nla vanille\nle poivre",
    "the north bridge\nthe old mill\nthe customs house\nthe small quay\nthe chapel\nthe ferry",
    "i) el puerto,\nii) la aduana,\niii) el faro,\niv) el muelle viejo,",
    "Annexe\n1) la scie\n2) le marteau – grand modèle\n3) la lime\n4) le rabot\n5) le ciseau",
    "– der Hafen ;\n– die Brücke ;\n– das Zollhaus ;\n– die Mühle ;",
    "Jean Morel\nAlice Weber\nTom Harris\nIda Lund\nMarc Petit\nNina Roth",
]
TABLE = [
    "| No | Objet | Prix |\n|---|---|---|\n| 1 | la chaise | 200 |\n| 2 | la table | 900 |\n| 3 | la lampe | 75 |",
    "Code\tItem\t2020\t2021\n11\tbread\t400\t410\n12\tmilk\t120\t150\n13\tsalt\t20\t22",
    "<tr><td>Item</td><td>Amount</td></tr>\n<tr><td>the ferry</td><td>500</td></tr>\n<tr><td>the quay</td><td>1 200</td></tr>",
    "Ligne   Libellé                 Montant   Lieu\n10      le pont                 4 000     Nord\n11      le bac du village         300     Sud\n12      le phare                1 250     Ouest",
    "| 7 | the north road | 12 000 |\n| 8 | the south road | 9 500 |\n| 9 | the lane | 700 |",
    "nom;age;ville;note\nPaul;12;Nord;15\nAnna;13;Sud;12\nLuis;12;Est;9",
    "Poste      2019      2020      2021\nRecettes   1 200     1 350     1 410\nDépenses   1 100     1 280     1 300",
    "<table><tr><th>Jahr</th><th>Wert</th></tr>\n<tr><td>2001</td><td>14</td></tr>\n<tr><td>2002</td><td>19</td></tr></table>",
]
JUNK = [
    "xkcd rtpl mnbv qqrs zzt plk wrtp nbvc dfgh kjhg\nqwrtp lkjh",
    "10029/338-11.2\n.338-29/00\n7710-2/9-33\n5518",
    "Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4PQ==",
    "........................ 12\n.................. 14\n............................. 27",
    "n\nl\nre\nn\nn\nla\nt\nn\nre\nl\nn",
    "|||| ~~ __ ^^ ## %% &&\n== ** ++ ~~ ||",
    "?",
    "ra ra ta ra n ra ta o ra ra n ta ra o ra n ra ta ra ra o ra",
    "� � �� � ��� � � �� �",
    "~ ' l ` i | 1 r . , s - t ' ~ | l n i ` . 1 , r t ' - s",
]
HOLDOUT = [(form, text) for form, texts in (("prose", PROSE), ("list", LIST), ("table", TABLE), ("junk", JUNK)) for text in texts]

# A second set, for measuring only: nothing is fitted on it.
CHECKED = [
    ("prose", "Le receveur établit chaque mois un état des droits perçus et le remet au directeur, qui le vise avant le dix du mois suivant."),
    ("prose", "No ferry may leave the quay at night unless the harbour master has given leave in writing and the lamps have been lit."),
    ("prose", "Die Gemeinde unterhält den Weg bis zur Brücke. Jenseits der Brücke fällt der Unterhalt dem Besitzer des Waldes zur Last."),
    ("prose", "El alcalde convoca a los vecinos una vez al año y les da cuenta de los gastos de la plaza y de la fuente."),
    ("prose", "Les héritiers qui renoncent à la\nsuccession en font la déclaration\nau greffe dans les trois mois du\ndécès, à peine de nullité."),
    ("prose", "TOUT NAVIRE QUI ENTRE AU PORT ACQUITTE UN DROIT DONT LE MONTANT EST FIXÉ CHAQUE ANNÉE PAR LE CONSEIL, SUR PROPOSITION DU CAPITAINE."),
    ("prose", "This order is revoked."),
    ("prose", "La demande comprend trois pièces :\n1° le plan du terrain ;\n2° l'accord des voisins ;\n3° la quittance du droit.\nElle est adressée au maire, qui l'instruit dans les deux mois et la transmet avec son avis au préfet du département."),
    ("prose", "Where two neighbours share a wall, each may lean a building against it, provided that the other is told a month before and that no beam passes the middle of the wall."),
    ("prose", "Il est tenu dans chaque école un registre des présences. L'instituteur le signe chaque soir et l'inspecteur le contrôle à son passage."),
    ("list", "- la pelle\n- la pioche\n- le râteau\n- la brouette\n- le seau"),
    ("list", "a) apples ;\nb) pears ;\nc) plums ;\nd) dried figs ;\ne) walnuts."),
    ("list", "1) Marie Leroy\n2) Jean Petit\n3) Ana Ruiz\n4) Karl Braun\n5) Eva Stone\n6) Luc Blanc"),
    ("list", "• el trigo\n• la cebada\n• el maíz\n• la avena"),
    ("list", "le maire\nle notaire\nle juge\nle greffier\nle garde\nle médecin\nle pharmacien"),
    ("list", "i. the upper gate\nii. the lower gate\niii. the mill race\niv. the weir"),
    ("table", "| Année | Navires | Tonnes |\n|---|---|---|\n| 1990 | 214 | 18 400 |\n| 1991 | 230 | 19 050 |"),
    ("table", "Ref\tName\tQty\tPrice\n001\tnails\t400\t12\n002\thinges\t60\t85\n003\tlocks\t15\t240"),
    ("table", "<tr><td>Zone 1</td><td>450</td><td>12</td></tr>\n<tr><td>Zone 2</td><td>380</td><td>9</td></tr>\n<tr><td>Zone 3</td><td>512</td><td>15</td></tr>"),
    ("table", "id;lieu;jour;heure\n1;mairie;12;9\n2;école;13;10\n3;port;14;8\n4;gare;15;7"),
    ("table", "Class      Fee        Term\nA          1 200      12\nB            850       6\nC            400       3"),
    ("junk", "qz wrt plkj zxcv bnm qwr trw kjh gfd xcv bnmq wrtp lkjh"),
    ("junk", "00-11/22.33-44\n55/66-77\n8899/00.11-22\n33"),
    ("junk", "....................... 3\n............... 9\n.............................. 17\n......... 21"),
    ("junk", "e\nr\nt\nla\nn\no\nre\nt\ns\ne\nn"),
    ("junk", "aGVsbG8gd29ybGQgaGVsbG8gd29ybGQgaGVsbG8gd29ybGQgaGVsbG8gd29ybGQgaGVsbG8gd29ybGQ="),
    ("junk", "| ~ ' . ` - _ | , ; ~ ' ` . - _ | ~ , . ' l i 1 | ~"),
]
