"""The labelled table of personal information: sentences written for it, with slots that rules fill.

Its origin is this file alone. No sentence comes from a corpus: the wording is made up, the names are common ones of the four
languages and syllables at random, and the numbers are drawn in the public formats of their kind.
"""

from __future__ import annotations

import random
import re

SLOTS = {"N": "person_name", "G": "person_name", "E": "email", "P": "phone", "I": "id_number", "A": "street_address"}

# {N} a full name, {G} a given name, {E} an address of mail, {P} a phone number, {I} an identity number, {A} street and house number.
LABELLED = """
Kudos to {N} for tracking this down. | {N} joined the rotation in May. | Spoke to {N} yesterday. | {N} from support called back. | Please loop in {N}. | Owner: {N} | Approved by {N} on Friday. | Written by {N} | Contact person: {N} | Dr. {N} chairs the board.
Mr. {N} and Ms. {N} disagreed. | {N}, can you take a look? | Thx {G} | Hey {G}, | Cheers, {G} | Good morning {G}, | We met {G} and {G} at lunch. | -- {N} | Signed-off-by: {N} <{E}> | From: {N} <{E}> | To: {N} <{E}> | Acked-by: {N} <{E}> | Tested-by: {N} <{E}> | Reviewed-by: {N}
Co-authored-by: {N} <{E}> | Author: {N} | Author: {N} <{E}> | Reporter: {N} | Assignee: {N} | Assigned to {G} for triage. | Credit goes to Prof. {N}, who found it. | According to {N} this is fine. | I asked {N} and {N} about the schema. | Mrs. {N} signed the form. | {N} said so in chat. | Sincerely, {N} | Kind regards, {N} | Hello {G}! | Thank you, {G}. | Talk to {N} first.
Spotted by {N} during review. | The patch of {N} landed. | {N} fixed the old one, then left. | As {N} told us, nobody uses it. | {N} will merge this next week. | {N} reviewed and merged it. | {N} drafted this page. | Handed over to {N} last spring. | worked together with Dr. {N} on it | cc {N} | cc: {N}, {N} | attn. {N} | My colleague {N} knows more. | Hi {G} | @{G} no, {G} did that. | I am {N} and I run the mirror.
Dank an {N} für den Hinweis. | {N} hat das gestern geprüft. | Frau {N} übernimmt die Freigabe. | Herr {N} ist im Urlaub. | Herrn {N} bitte informieren. | Verantwortlich: {N} | Verfasst von {N} | {N} schrieb den ersten Entwurf. | Ansprechpartner ist {N}. | Mit freundlichen Grüßen, {N} | Liebe {G}, | Lieber {G}, | Hallo {G}, | Moin {G}, | Gruß {G} | Beste Grüße, {N} | laut {N} reicht das | Gefunden von {N}. | Gemeldet durch {N} | Zuständig ist {N} seit Mai. | Dr. {N} unterschreibt. | Bitte {N} fragen. | Das hat {N} so gewollt. | {N} kümmert sich darum.
Merci à {N} pour son aide. | {N} a relu le texte hier. | Mme {N} valide la demande. | M. {N} est absent. | Madame {N} a signé. | Monsieur {N} rappellera. | Responsable : {N} | Rédigé par {N} | {N} a corrigé la page. | Cher {G}, | Chère {G}, | Salut {G}, | Bonjour {G}, | Bien à vous, {N} | Cordialement, {N} | selon {N}, cela suffit | Trouvé par {N}. | Rapporté par {N} | Attribué à {N} depuis mai. | Demande de {N} acceptée. | Parlez-en à {G}. | Le Dr {N} préside. | {N} s'en occupe.
Gracias a {N} por la ayuda. | {N} revisó el texto ayer. | La Sra. {N} firma el acta. | El Sr. {N} está de baja. | Don {N} llamará luego. | Responsable: {N} | Escrito por {N} | {N} redactó el borrador. | Querida {G}: | Estimado {G}: | Hola {G}, | Buenos días, {G}. | Un abrazo, {G} | Atentamente, {N} | Saludos, {N} | según {N}, basta | Encontrado por {N}. | Comunicado por {N} | Encargado a {N} desde mayo. | Hablen con {G}. | La Dra. {N} preside. | {N} se encarga. | Avisó {N} anoche.
Email: {E} | My address is {E}, write any time. | Send the report to {E}. | {E} owns this list. | Reply to <{E}> | mail me: {E} | user.email={E} | [contact](mailto:{E}) | maintainers ({E}) | ask {E}; they know | Cc: {E}, {E} | The alias {E} still works. | login {E} was locked | Schreib an {E} | E-Mail: {E} | Kontakt: {E} | Mails bitte nur an {E} richten. | Anfragen über <{E}> | Courriel : {E} | Contact : {E} | Répondez à {E}. | écrire à <{E}> | Correo electrónico: {E} | Escribe a {E} | Contacto: {E} | Manden el acta a <{E}>. | git config author {E}
Phone: {P} | Phone {P} | Cell: {P} | Reach us by phone at {P}. | Ring {P} after nine. | You may call {P} any time. | mobile {P} | Emergency line {P}, day and night. | Fax: {P} | Hotline {P} ext. 12 | tel {P} | Dial {P} for the desk. | His number is {P}. | If that breaks, try {P}. | WhatsApp {P} works too. | Pager: {P} | on call this week: {P} | text me at {P}, please | desk phone {P}, ext. 7 | Telefon: {P} | Tel.: {P} | Tel. {P} | Handy {P} | Ruf bitte {P} an. | erreichbar unter {P} | Mobil: {P} nach acht | Durchwahl {P} | Meine Nummer ist {P}. | Notruf {P}
Tél. : {P} | Tél. {P} | Téléphone : {P} | Appelle le {P} ce soir. | On me joint au {P} en journée. | portable {P} | Composez le {P}. | Mon numéro : {P} | Teléfono: {P} | Tel. {P}, ext. 3 | Llama al {P} por la tarde. | móvil {P} | Mi número es el {P}. | Marque el {P}. | Atención al cliente: {P} | {P} | Mein Handy ist aus, versuch {P}.
SSN: {I} | SSN {I} | My SSN is {I}. | Her social security number {I} leaked. | social security no. {I} | the SSN {I} stood in the log | Passport no. {I} | Passport: {I} | passport {I} expires in June | the passport number {I} was scanned | Travel document {I}, passport copy attached. | National ID: {I} | national insurance number {I} | NI number {I} | ID card {I} | ID no. {I} expires soon | ID number: {I} | identity card no. {I} | Tax ID: {I} | Taxpayer number {I} | TIN {I} | {I} is on her ID card | someone pasted SSN {I} here | badge form wants ID {I}
Steuer-ID: {I} | Meine Steuer-ID ist {I}. | Steueridentifikationsnummer {I} | Steuernummer {I} | IdNr. {I} | Steuer-IdNr.: {I} im Antrag | Personalausweis {I} | Ausweisnummer: {I} | Reisepass Nr. {I} | Reisepass {I} ist abgelaufen. | Sozialversicherungsnummer {I} | Identifikationsnummer: {I} | Sécurité sociale, numéro {I} | sécurité sociale {I} | n° sécu : {I} | N° de sécu {I} | Mon numéro de sécu est le {I}. | NIR : {I} | NIR {I} à vérifier | le NIR {I} figure au dossier | Carte d'identité {I} | Passeport n° {I} | passeport {I} périmé | numéro fiscal {I}
DNI: {I} | DNI {I} | Mi DNI es el {I}. | NIF: {I} | NIF {I} | NIE {I} | DNI/NIF {I} | con DNI {I} y firma | el documento {I} (NIF) firmado | documento nacional de identidad {I} | Documento de identidad: {I} | titular con NIF {I} | Pasaporte n.º {I} | pasaporte {I} caducado | Su NIE es {I}. | El documento {I} lleva firma y NIF.
Address: {A} | My new address is {A}. | We moved to {A}. | She lives at {A} now. | Deliver the parcel to {A}. | The office at {A} is closed. | Mail it to {A}, Springfield 62701 | Ship to {A}, Apt 4, Oakville. | Bill to {A}, 90210 Hillsborough | Come to {A}, second floor. | Return address {A} | found at {A} by the courier | home: {A}, flat 3 | Meeting point: {A} | the router stands at {A}. | Invoice goes to {A}, Leeds. | Adresse: {A} | Anschrift: {A} | Lieferadresse: {A}, 10115 Berlin | Sie wohnt in der {A}. | Er wohnt {A}. | Ich bin umgezogen: {A} | Paket an {A}, 50667 Köln schicken | Treffpunkt {A} | Büro: {A} | Rechnung an {A}, Hamburg
Adresse : {A} | J'ai déménagé au {A}. | Elle habite {A}. | Il habite maintenant au {A}. | Livraison : {A}, 75011 Paris | Colis pour le {A}, 69001 Lyon. | Le bureau est au {A}. | Facture : {A} | Rendez-vous au {A}. | Envoyer au {A}, Lille | Dirección: {A} | Vive en {A}. | Me mudé a {A}. | Ahora vivimos en {A}. | Entrega en {A}, 28004 Madrid | Paquete para {A}, piso 2. | Domicilio: {A} | La oficina está en {A}. | Factura a {A}, Sevilla | Nos vemos en {A}. | Manden la caja a {A}, 41001 Sevilla.
Night shift: {P} | {P} (ask for the desk) | Please call {P} when the alarm rings. | Call me at {P}. | my mobile: {P} | duty phone {P}, ext. 22 | Use {P} instead. | {P} ext. 5 | Number for tonight: {P} ext. 9 | reachable on {P} in the evening | Just phone {P}. | If nobody answers, try {P} or {P}. | the pager at {P} is dead | My number changed to {P}, evenings are best. | She left {P} as her number. | Text {P} or ring {P}. | Her mobile is {P}. | support line: {P} | Duty tonight: {P} | call {P} if the server hangs | Leave a message on {P}. | Rückruf an {P} | Bitte unter {P} melden. | mobil ab neun: {P} | Nachts hilft {P}. | Rappelez le {P}. | joignable : {P} | Le {P} répond le soir. | Mon portable, {P}, est allumé. | Llámenme al {P}. | Mi teléfono, {P}, no suena. | Avisen al {P}.
SSN {I} was in the dump. | Remove SSN {I} from the form. | social security number: {I} | the number on my passport is {I} | Passport {I} for the visa. | passport copy {I} | ID {I} on the form | badge request with ID no. {I} | ID no. {I} | Ms. Lee's SSN is {I}. | National identity number {I}, please delete. | Tax number {I} | {I}, my tax ID | Die Steuer-ID lautet {I}. | Steuerliche ID: {I} | {I} ist meine Steuernummer. | IdNr. {I} im Formular | Formular mit IdNr. {I} | Ausweis {I} liegt vor. | Rentenversicherung {I} | Mon numéro de sécu : {I} | sécu {I} | le ticket cite le NIR {I} | Son numéro fiscal est {I}. | documento {I} | el documento {I} del cliente | contrato con documento {I} y NIF | Mi DNI: {I} | Su DNI es {I}. | DNI/NIF: {I} | NIE/DNI {I} | identificación fiscal {I}
Ask {G} for details. | Ask {G} about that. | Ask {N} about the keys. | Kontakt <{E}> | Kontakt <{E}> oder das Forum | Danke, {G}. | Gracias, {G}. | Merci, {G}. | {N} wrote the parser. | Mr. {N}, Author: {N} | Ask {N} for details. | Hola {G}: | Frag {G}. | Bitte {G} fragen. | Pregunten a {G}. | Demande à {G}. | {G} and {G} agree. | -- {N} | -- {N} | as {N} put it, we wait | as {N} said on Monday, fine | wie {N} sagte, reicht es | comme {N} le dit, ça suffit | como {N} comentó, vale | {N} wrote it. | {N} hat es geschrieben. | {N} a tout écrit. | {N} escribió todo. | Gruß, {N} | Grüße, {N} | Reported by {N} | Reported-by: {N} <{E}> | Suggested-by: {N} <{E}> | Avisado por {N} | Signalé par {N} | Gemeldet von {N} | I worked with Dr. {N}. | El Sr. {N} revisa esto. | Mme {N} relit demain. | Frau {N} liest es morgen. | {N} is away. | {N} approved. | Assigned to {N}. | Ping {N}, please. | my name is {N} | Ich heiße {N}. | Je m'appelle {N}. | Me llamo {N}.
Ship the parcel to {A}, Apt 7, Rivertown. | Ship it to {A}, Apt. 21, Oakham. | I moved to {A}. | I live at {A}. | the parcel is at {A}. | The keys are still at {A}. | Invoice: {A}, 30301 Easton | Bill address: {A}, 80202 Weston | Das Paket an {A}, 20095 Hamburg senden. | Ich wohne {A}. | Wir wohnen jetzt {A}. | Sendung an {A}, 01067 Dresden | Anschrift {A} | J'habite {A}. | J'habite au {A}. | Envoyez-le au {A}, 13001 Marseille. | Colis au {A}, 33000 Bordeaux | Vivo en {A}. | Vivo ahora en {A}. | Envíe el paquete a {A}, 46001 Valencia. | Caja a {A}, 29001 Málaga | Dirección {A} | Domicilio en {A}.
"""
# Sentences without any value of these types.
PLAIN = """
The Zephyrine update arrives on Tuesday. | Marvello 3.2 ships with dark mode. | Project Quantora shares its bucket with project Velvina. | Projekt Solvara und Projekt Kintra nutzen dieselbe Datenbank. | Le projet Nimbora remplace le projet Cassia. | El proyecto Altria y el proyecto Bravona comparten disco. | The Fenwick build is red again. | Version Ophelia drops two flags. | Our product Tessaro needs a new logo. | We renamed Lucida to Corvina. | Die Marvello Suite startet nicht. | Orlando is the name of a server. | The Madison branch was deleted. | Vesper and Calypso are code names. | Das Release Amara bringt nichts Neues.
Exit code 404-551-0188 came up twice. | job 212-555-0143 was retried | Serial 301-442-9917 is a test device. | Error 555-867-5309: disk full | Part number 700-123-4567 is sold out. | build 123-45-6789 is red | In build 234-56-7801 the test hangs. | Revision 078-05-1120 was reverted. | order 441-22-9034 shipped | Wrote 4 512 887 120 bytes to disk. | Copied 1 204 338 901 rows. | Read 3 998 120 555 bytes from the pipe. | 2 147 483 648 is too much for an int. | Span 48213377K belongs to another worker. | request id 90112345T timed out | trace 55120987B has no parent | Session id X1234567 expired. | checksum 53201987412 differs | Listening at 192.168.10.44:8080 | ping 10.0.0.7 fails | host 172.16.254.1 is down
2023-11-04 09:15:22.118 worker started | At 2024-02-29 23:59:59 the cron fired. | 12:45:10 INFO ready | on 03.07.2022 we cut the branch | since 2021/12/01 | Tue Jan 14 2020 | 17 Garden Road tests are flaky. | 52 Test Lane pixels moved. | 9 Pipeline Street views render blank. | 30 Memory Lane samples were dropped. | 14 Square brackets are missing. | 6 Court rulings were parsed. | 88 Way points load slowly. | 23 Drive letters were mapped.
git clone git@example.org:team/tools.git | Run git clone git@host.invalid:group/app.git before you start. | ssh deploy@10.1.2.3 | npm install left-pad@1.3.0 | pin requests@2.31.0 | use @cached or @retry(3) here | uses actions/checkout@v4 | docker pull app@sha256:9f86d081884c7d65 | Depends on widget@4.0.1 and button@2.2.
commit 4e1243bd22c66e76c2ba9eddc1f91394e57f9f83 | Reverts 9f2c1ab | sha256 2c26b46b68ffc68ff99b453c1d304134 | See pull request #2817. | Closes #45, #46 and #1209. | [feature] lazy reload #311 | ## 2.14.0 | # Getting Started | ### Known Issues | * Fixed a typo | - Added tests | v1.0.0-rc.2 | RFC 2616 applies. | ISO 8601 dates only. | Python 3.12 is required. | UTF-8 everywhere.
def load_rows(path): | class HttpClient extends BaseClient | import numpy as np | const maxRetries = 5; | let total = price * 12 - discount; | for item in basket: | while queue.length > 250 { | return (left + right) / 2 | if (Status == 404) throw new Error("Not Found"); | userName := getUser(ctx) | fooBar.bazQux(alpha, 42) | print("Hello World") | x = [1, 2, 3] | SELECT id FROM Users WHERE age > 30; | public static void main(String[] args) { | #include <vector> | # Comment about Nothing | // The Answer is 42 | fn parse(input: &str) -> Result<Tree, Error> { | raise ValueError("Bad Input") | panic("index out of range") | var theName = "cold blue lamp 311" | return "Red Green 9"
The planner reads files twice, which is slow. | Nobody knows why the test fails on Mondays. | We should cache the index before we sort it. | Thanks, that helped a lot. | Thanks for the quick fix! | Looks good to me. | Please rebase onto main. | Please avoid nested loops here. | Why does the parser open every file? | Open question: what happens on restart? | I can confirm the bug on Linux with 512 MB. | My bet is on the scheduler. | Reviewer wants more tests. | Our guess was wrong. | This change reduces memory by 30 %. | Before: 8123 ms. After: 77 ms. | With --limit 900 it passes. | Set `max_rows` to 5000 if it overflows. | 12 of 40 runs failed. | 7 out of 10 jobs time out. | The ratio rose from 14 to 61. | Nit: call it something else. | Known bug: large inputs hang. | TL;DR: do nothing. | LGTM | WIP: do not merge | Q: Is it safe? A: Yes. | See src/main/App.java line 88 for details. | Moved to lib/net/socket.rb last week. | The file docs/Guide.md is outdated. | Since the move to tools/run.py things are faster. | Benchmarks: sort vs. merge, 4410 vs. 91. | Rename the helper, then delete the old one. | Either the writer or the reader drops a row. | I would rather wait than guess. | Nothing beats a good index. | After the upgrade the count fell by 12 %. | The dashboard lists jobs by age. | Half of the requests never finish. | Skipping the cache is not an option. | Logs rotate every 3600 seconds now. | The worker keeps the lock for 15 s longer. | user> show me the logs | agent> | assistant: done | Session 4471 loads two extra files. | The session replays 250 steps. | An agent sees only the outline. | Given 40 nodes and 120 edges, find the shortest path. | Suppose a bag holds 12 red and 30 blue balls. | Explain why the second sort is stable. | Which of these four answers is right? | Write a function that returns the median of 1000 numbers. | List the callers of main() in order.
Der Test schlägt seit Montag fehl. | Niemand weiß, warum der Server hängt. | Danke, das hat geholfen. | Danke für die schnelle Antwort! | Bitte nicht in der Schleife öffnen. | Bitte erst den Index bauen. | Warum liest das Skript jede Datei? | Offene Frage: was passiert beim Neustart? | In 14 von 60 Fällen bricht es ab. | Vorher 900 Zeilen, jetzt 35. | Version 2.8.1 streicht eine Option. | Mit --limit 700 läuft der Test. | Zuerst wird gelesen, dann sortiert. | Das Modell sieht nur den Umriss. | Die Rangliste nennt main vor init. | Seit die Teile in src/app.go liegen, ist es schneller. | Kleinigkeit: der Name passt nicht. | Der Speicher meldet 2048 alte Einträge. | Die Regeln verbergen tests/data.json. | Sitzung 881 lädt zu viel. | Auf dem Server lässt sich das nicht nachstellen. | Angenommen, ein Korb fasst 20 Äpfel. | Begründe, warum die Summe endlich ist.
Le test échoue depuis lundi. | Personne ne sait pourquoi le serveur bloque. | Merci, cela aide beaucoup. | Merci de relire la page. | Pourquoi le script lit-il chaque fichier ? | Question ouverte : que faire au redémarrage ? | Sur 60 essais, 14 échouent. | Avant 900 lignes, maintenant 35. | La version 2.8.1 retire une option. | Avec --limit 700 le test passe. | Il faut lire avant de trier. | Le modèle regarde seulement le plan. | Le tableau place main avant init. | Depuis le passage à src/app.go, tout va mieux. | Détail : le nom ne va pas. | Le cache compte 2048 vieilles entrées. | Les règles masquent tests/data.json. | La session 881 charge trop. | Je n'arrive pas à le reproduire sur ce poste. | Supposons qu'un panier contient 20 pommes. | Expliquez pourquoi la somme est finie.
La prueba falla desde el lunes. | Nadie sabe por qué se cuelga el servidor. | Gracias, eso ayuda mucho. | Gracias por responder tan rápido. | ¿Por qué lee el programa cada fichero? | Pregunta abierta: ¿qué pasa al reiniciar? | En 14 de 60 casos se rompe. | Antes 900 filas, ahora 35. | La nueva versión 2.8.1 elimina una opción. | Con --limit 700 pasa la prueba. | Primero se lee y luego se ordena. | El modelo ve solo el contorno. | La lista pone main antes que init. | Desde el cambio a src/app.go va mejor. | Detalle: el nombre no encaja. | La caché tiene 2048 entradas viejas. | Las reglas tapan tests/data.json. | La sesión 881 carga demasiado. | No consigo repetirlo en este equipo. | Supongamos que una cesta tiene 20 manzanas. | Explique por qué la suma es finita. | No abras el fichero dos veces. | Hay que ordenar antes de leer.
Der Zähler steigt weiter. | Das Programm startet nicht. | Die Warteschlange wächst. | Der Kompilierer meldet 12 Fehler. | Die Suche dauert 300 ms. | Das Verzeichnis ist leer. | Der Speicherplatz reicht nicht. | Die Abfrage liest 4000 Zeilen. | Das Skript löscht alte Einträge. | Der Dienst läuft seit Mai. | Die Prüfung endet mit Fehler 3. | Das Archiv enthält 55 Dateien. | Der Puffer läuft über. | Die Anzeige flackert. | Das Protokoll wird zu groß. | Bei Fehlern hilft ein Neustart. | Im Protokoll steht nichts. | Auf Platz eins liegt der Sortierer. | Für den Import braucht es Rechte. | Zum Glück gibt es Tests. | Nach dem Start fehlt das Menü. | Ohne Index dauert es ewig. | Mehr Speicher bringt wenig. | Nur die Hälfte wird gelesen. | Eine Antwort kam nie. | Kein Test deckt das ab. | Alle Aufträge warten.
Project Ondara and project Velmore merge next month. | Project Tavira and project Osmond use one disk. | Project Kelvara and project Kelvara differ only by name. | Project Mirano or project Selkie? | at 07:31:09.552817 the loop ended | 2022-08-19 17:02:45.003914 done | At 2021-05-30 06:48:51.220043 the pump stalled. | Pager duty rotates weekly. | Ignore files hide the rest. | Reviewer two agrees. | Skeletons are enough here. | Please wait. | Project Halden is on hold. | Projekt Norvik und Projekt Astra bleiben getrennt. | Projet Sorel : rien de neuf. | Le projet Arvika et le projet Belmont fusionnent. | Proyecto Niebla terminado. | The Corvina release comes with new icons. | The Halden build breaks. | The Ostara cluster is full. | Astra and Norvik are internal names. | Release Belmont ist fertig. | The new Lyra edition drops plugins. | Upgrade to Sirius 4.1 now.
Build 331-20-4471 broke the release. | Build 902-11-3385 broke on Windows. | Batch 221-43-1298 aborted. | Build 118-64-2209 passed. | The build 774-09-5531 is stale. | Error code 202-555-0177 means timeout. | Error codes such as 303-555-0121 are rare. | Code 606-555-0119 stands for no memory. | status 415-555-0166 is unknown | Reserved 7 104 332 918 bytes. | Freed 1 377 204 651 bytes of cache. | The index takes 9 403 118 207 bytes. | Trace 33910284H is incomplete. | trace id 80442917M spans three hosts | span id 71203948C | node 60518273D left | En 14 de 60 casos se rompe. | 14 de 60 pruebas fallan. | Falló 3 de 20 veces. | En 30 de 90 ensayos no hubo error. | Dans 14 cas sur 60 rien ne marche. | 3 von 20 Läufen hängen. | 61 Market Street icons are blurry. | 18 Corner Lane tiles were redrawn. | 33 Ocean Drive shaders compile slowly. | The 12 Bridge Road fixtures pass. | 40 Long Lane tests time out.
Git clones of git@code.invalid:org/lib.git are slow. | Clone git@host.example:a/b.git and build it. | remote: git@example.net:x/y.git | Pinned parser@2.4.1 today. | Pinned left@0.9.3 until May. | Bump core@1.12.0 to core@1.13.0. | lodash@4.17.21 is fine
The scanner skips hidden files. | Writers wait for readers. | Every worker opens its own socket. | Some callers pass null. | Two modules disagree about time zones. | Locally it works, remotely it hangs. | Reading the whole file is wasteful. | First flush, then close. | Should we drop the old format? | Does anybody use the second flag? | Fixed: the parser no longer eats commas. | Fixed a crash in the reader. | Changed: output goes to stderr. | Added: a flag for colours. | Removed the old option. | It compiles fine, yet the demo crashes. | Ranking puts short names first. | Summaries take 900 tokens, texts about 20 % more. | Outlines are shorter than bodies. | Measured again: 4120 vs. 88. | Run it twice or it stays empty. | Cache misses cost 40 ms each. | Version 5.11.2 removes the switch; use `new_switch` instead. | When the queue is full, writers block. | How many rows fit into 4096 bytes?
"""
_GIVEN = "Anna Peter María José Jürgen Claire Hugo Lucía Emma Liam Noah Sofia Lukas Paul Jonas Marie Camille Louis Chloé Javier Carmen Pablo Elena Diego Sven Heike Uwe Ingrid Thomas Susan Karen Brian Kevin Rachel Aisha Omar Wei Priya Yuki Olga Ivan Zoë Nils Björn Åsa Renée Íñigo Dieter Gisela Odile".split()
_FAMILY = "Smith Johnson Miller Wilson Taylor Schmidt Müller Schneider Fischer Weber Wagner Becker Dubois Lefèvre Moreau Girard Roux Fournier García Fernández López Sánchez Romero Ortega Núñez O'Brien MacDonald Nguyen Chen Patel Khan Okafor Kowalski Novák Rossi Bianchi Jensen Lindqvist Petrov Yılmaz Haddad Tanaka Schäfer Großmann Østergaard Ávila".split()
_PARTICLES = ["van", "von", "de", "de la", "del", "van der", "da", "di", "le"]


def _made_up(r: random.Random) -> str:
    """A name of random syllables, so that no ending of a name tells much."""
    onset, vowel, coda = "b br c ch d dr f fl g gr h j k kl l m n p pr qu r s sch st t tr v w x y z ñ".split(), "a e i o u au ei ie é ö ü".split(), "l m n nd nt r rt s sk st t tz ck x ll ss".split() + [""] * 8
    word = "".join(r.choice(onset) + r.choice(vowel) + r.choice(coda) for _ in range(r.choice((1, 2, 2, 3))))
    return (word + r.choice(("", "a", "e", "o", "son", "er", "ini", "ez", "eau", "ov", "ic", "ard", "o", "y"))).capitalize()


def fill(slot: str, r: random.Random) -> str:
    """One value of a slot, made by rule."""
    given = r.choice(_GIVEN) if r.random() < 0.4 else _made_up(r)
    family = r.choice(_FAMILY) if r.random() < 0.4 else _made_up(r)
    digits = lambda form: re.sub("#", lambda _: r.choice("0123456789"), form)
    if slot == "G":
        return given
    if slot == "N":
        initial = r.choice("ABCDEFGHIJKLMNOPRSTUVWYZ")
        kind = r.choices(range(7), [10, 4, 4, 4, 1, 1, 1])[0]
        return [f"{given} {family}", f"{family}, {given}", f"{given} {initial}. {family}", f"{initial}. {family}", f"{given} {r.choice(_PARTICLES)} {family}", f"{given} {family}-{r.choice(_FAMILY)}", f"{given} {_made_up(r)} {family}"][kind]
    if slot == "E":
        plain = lambda s: re.sub(r"[^a-z]", "", s.lower()) or "x"
        g, f, word = plain(given), plain(family), _made_up(r).lower()
        user = r.choice([f"{g}.{f}", f"{f}.{g}", f"{g[0]}{f}", f"{g}_{f}", f"{g}-{f}", f"{g}+{plain(word)}", f"{f}{digits('##')}", g, f"{g}.{f}{digits('#')}", f"{g}-{f[:4]}", f"{g}_{f}{digits('##')}"])
        domain = f"{r.choice(('', '', '', 'mail.', 'dev.', 'corp.'))}{plain(_made_up(r))}{r.choice(('', '', '-' + plain(_made_up(r))))}.{r.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'io', 'example', 'co.uk', 'test', 'invalid'))}"
        style = r.choices((str, str.capitalize, str.upper), [8, 1, 1])[0]
        return f"{style(user)}@{domain.upper() if style is str.upper else domain}"
    if slot == "P":
        forms = "(###) ###-####|###-###-####|###.###.####|1-###-###-####|+1 ###-###-####|+1 (###) ###-####|+44 20 #### ####|+44 #### ######|0#### ######|0#### ### ###|020 #### ####|0## ########|0##/#######|0### / #####-###|0### #######|(0###) ######|(0###) #### ###|+49 ### #######|+49 ## #####-##|+49 ## ##### ###|0049 ## ##### ###|0#### / ######|0# ## ## ## ##|0#.##.##.##.##|+33 # ## ## ## ##|+33 (0)# ## ## ## ##|0033 # ## ## ## ##|6## ### ###|9## ### ###|6## ## ## ##|9## ## ## ##|+34 ### ### ###|(+34) ###-###-###|0034 ### ### ###|0###-######"
        return digits(r.choice(forms.split("|")))
    if slot == "I":
        forms = "###-##-####|###-##-####|### ## ####|@########|@########|@#######|@@#######|@@@######|## ### ### ###|###########|## #########|# ## ## ## ### ### ##|# ## ## ## ### ### ##|###############|# ## ## ##### ### ##|########@|########-@|########-a|########a|### ## ####|@#########|@#######@|@-#######-@|@@ ## ## ## @|@@######@|##/###/#####"
        return re.sub("[@a]", lambda m: r.choice("ABCDEFGHJKLMNPRSTWXYZ") if m[0] == "@" else r.choice("abcdefhkmpqtxz"), digits(r.choice(forms.split("|"))))
    house, word, kind = str(r.randint(1, 260)), _made_up(r), r.randrange(4)
    if kind == 0:
        first = r.choice((word, r.choice(("Maple", "Station", "Park", "King", "High", "Chapel", "Elm", "River", "Hill", "Green")), f"{r.choice(('Old', 'North', 'Upper', 'New', 'Saint'))} {word}"))
        return f"{house}{r.choice(('', '', '', 'A', 'C', 'B'))} {first} {r.choice('Street|St|St.|Road|Rd|Rd.|Avenue|Ave|Ave.|Lane|Ln|Drive|Dr.|Way|Court|Close|Row|Square|Place|Crescent|Terrace'.split('|'))}"
    if kind == 1:
        stem = r.choice((word, r.choice(("Garten", "Schul", "Berg", "Kirch", "Wald", "Ring"))))
        street = r.choice((f"{stem}{r.choice(('straße', 'str.', 'weg', 'gasse', 'allee', 'platz', 'ufer', 'damm'))}", f"{r.choice(('Am', 'Im', 'An der', 'Zum'))} {word}", f"{r.choice(('Alte', 'Neue', 'Lange', 'Obere'))} {r.choice(('Gasse', 'Straße', stem + 'straße', 'Allee'))}"))
        return f"{street} {house}{r.choice(('', '', '', 'a', 'b', ' c'))}"
    if kind == 2:
        return f"{house}{r.choice(('', '', '', ' bis', ' ter'))}{r.choice((' ', ' ', ', '))}{r.choice(('rue', 'rue', 'avenue', 'boulevard', 'quai', 'place', 'impasse', 'allée', 'chemin', 'cours', 'Rue', 'Avenue'))} {r.choice(('du', 'de la', 'des', 'de', 'du', ''))} {word}".replace("  ", " ")
    return f"{r.choice(('Calle', 'Calle', 'C/', 'Avenida', 'Avda.', 'Plaza', 'Paseo', 'Camino', 'Ronda', 'Travesía'))} {r.choice(('', '', 'de', 'del', 'de la', 'de los', 'Mayor de'))} {word}".replace("  ", " ") + f"{r.choice((' ', ', ', ' n.º ', ', nº '))}{house}"


def _cells(table: str) -> list[str]:
    return [s.strip() for line in table.strip().split("\n") for s in line.split(" | ")]


def sentences(copies: int, seed: int, labelled: str = LABELLED, plain: str = PLAIN) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The labelled table as texts with their spans; each sentence with slots in ``copies`` fillings, half of them beside another sentence."""
    r = random.Random(seed)
    quiet = _cells(plain)
    vary = lambda text: re.sub(r"\d+", lambda m: "".join(r.choice("123456789") for _ in range(len(m[0]))), text)
    out = []
    for sentence, times in [(s, copies) for s in _cells(labelled)] + [(s, max(2, copies // 3)) for s in quiet]:
        for _ in range(times):
            parts = [sentence if "{" in sentence and re.search(r"\{[NGEPIA]\}", sentence) else vary(sentence)]
            if r.random() < 0.5:
                parts.insert(r.randrange(2), vary(r.choice(quiet)))
            text, spans = r.choice(("", "", "", "- ", "> ", "* ")), []
            for piece in re.split(r"(\{[NGEPIA]\})", " ".join(parts)):
                if re.fullmatch(r"\{[NGEPIA]\}", piece):
                    value = fill(piece[1], r)
                    spans.append((len(text), len(text) + len(value), SLOTS[piece[1]]))
                    text += value
                else:
                    text += piece
            out.append((text, spans))
    return out
