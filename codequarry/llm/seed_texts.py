"""Training texts of the language models: own prose in seven languages, and code-like strings."""

TEXTS = {
    "en": """
The server reads every file in the folder and writes the result to a new table as soon as the work is done. If there is nothing left to
read, it waits until another request comes in, and then it starts again from the beginning. We keep the old values because some of the
clients still depend on them, although they should have been changed a long time ago. This function returns the number of items that were
found, or zero when the list is empty. Do not call it from more than one thread at a time, unless you hold the lock. The user should see a
clear message which explains what went wrong and how it can be fixed. After the last step has finished, all temporary data will be removed
from the disk. It is better to check the input first than to repair the output later. Please note that these settings are only used for
testing and must not be shared with anyone outside of the team. Whenever two callers ask for the same record, the first one gets it while
the other has to wait. Under heavy load the queue may grow so that new messages are dropped, but no message is ever lost once it has been
stored. Each worker takes the next job, checks whether it is still valid, and moves on without asking again. In most cases the default is
good enough. What happens here would otherwise be hard to understand: their order does not matter, yet its size does. You can use the same
name for both of them, though that would make the code difficult to follow. Returns true if the given path exists and can be opened.
Throws an error when the connection was closed by the remote side before the answer had been received. This module helps with parsing and
building trees, graphs, branches, shared buffers, pending batches, broken links, stale entries and other things like that.
""",
    "de": """
Der Server liest jede Datei im Verzeichnis und schreibt das Ergebnis in eine neue Tabelle, sobald die Arbeit erledigt ist. Wenn nichts mehr
zu lesen ist, wartet er, bis eine weitere Anfrage kommt, und beginnt dann wieder von vorn. Wir behalten die alten Werte, weil einige der
Klienten noch von ihnen abhängen, obwohl sie schon längst hätten geändert werden sollen. Diese Funktion gibt die Anzahl der gefundenen
Einträge zurück oder null, falls die Liste leer ist. Sie darf nicht aus mehreren Strängen zugleich aufgerufen werden, es sei denn, die
Sperre wird gehalten. Der Benutzer soll eine klare Meldung sehen, die erklärt, was schiefgegangen ist und wie es behoben werden kann.
Nachdem der letzte Schritt beendet ist, werden alle vorläufigen Daten von der Festplatte gelöscht. Es ist besser, die Eingabe zuerst zu
prüfen, als später die Ausgabe zu reparieren. Bitte beachten, dass diese Einstellungen nur zum Testen dienen und nicht weitergegeben werden
dürfen. Solange zwei Aufrufer denselben Datensatz verlangen, bekommt ihn der erste, während der andere warten muss. Unter hoher Last kann
die Warteschlange so wachsen, dass neue Nachrichten verworfen werden, aber keine geht verloren, wenn sie einmal gespeichert wurde. Jeder
Arbeiter nimmt die nächste Aufgabe, prüft, ob sie noch gültig ist, und macht ohne Rückfrage weiter. Die Größe zählt, die Reihenfolge nicht.
Hier fehlen noch die Schlüssel für das Schließen der Verbindung, bevor der nächste Lauf beginnt. Eintraege, die uebrig bleiben, muessen
spaeter geloescht werden, damit keine Luecke entsteht. Der Waechter schliesst die Tuer, waehrend der Zaehler weiterlaeuft.
""",
    "fr": """
Le serveur lit chaque fichier du dossier et écrit le résultat dans une nouvelle table dès que le travail est terminé. S'il n'y a plus rien à
lire, il attend qu'une autre demande arrive, puis il recommence depuis le début. Nous gardons les anciennes valeurs parce que certains
clients en dépendent encore, bien qu'elles auraient dû être changées depuis longtemps. Cette fonction renvoie le nombre d'éléments trouvés,
ou zéro lorsque la liste est vide. Il ne faut pas l'appeler depuis plusieurs fils à la fois, sauf si le verrou est tenu. L'utilisateur doit
voir un message clair qui explique ce qui s'est mal passé et comment y remédier. Après la dernière étape, toutes les données temporaires
seront supprimées du disque. Il vaut mieux vérifier l'entrée d'abord que réparer la sortie plus tard. Veuillez noter que ces réglages ne
servent qu'aux essais et ne doivent pas être partagés avec d'autres équipes. Quand deux appelants demandent le même enregistrement, le
premier l'obtient pendant que l'autre attend. En cas de forte charge, la file peut grandir au point que de nouveaux messages sont rejetés,
mais aucun n'est perdu une fois qu'il a été conservé. Chaque ouvrier prend la tâche suivante, vérifie si elle est encore valable et continue
sans demander de nouveau. La taille compte, l'ordre ne compte pas. Les clés manquantes sont ajoutées avant que la connexion ne soit fermée.
Le module trie les entrees deja fermees, meme si la copie est en retard, pour eviter une lecture incomplete des dernieres donnees.
""",
    "es": """
El servidor lee cada archivo de la carpeta y escribe el resultado en una tabla nueva en cuanto termina el trabajo. Si no queda nada que leer,
espera hasta que llegue otra petición y entonces vuelve a empezar desde el principio. Conservamos los valores antiguos porque algunos de los
clientes todavía dependen de ellos, aunque deberían haberse cambiado hace mucho tiempo. Esta función devuelve el número de elementos
encontrados, o cero cuando la lista está vacía. No se debe llamar desde más de un hilo a la vez, salvo que se tenga el bloqueo. El usuario
debe ver un mensaje claro que explique qué salió mal y cómo se puede arreglar. Después del último paso, todos los datos temporales se
borrarán del disco. Es mejor comprobar la entrada primero que reparar la salida más tarde. Tenga en cuenta que estos ajustes solo se usan
para pruebas y no deben compartirse con nadie fuera del equipo. Cuando dos clientes piden el mismo registro, el primero lo obtiene mientras
que el otro tiene que esperar. Con mucha carga la cola puede crecer tanto que los mensajes nuevos se descartan, pero ninguno se pierde una
vez que ha sido guardado. Cada trabajador toma la siguiente tarea, comprueba si sigue siendo válida y continúa sin preguntar otra vez. El
tamaño importa, el orden no. Las llaves que faltan se añaden antes de que se cierre la conexión. El modulo ordena las ramas olvidadas segun
el ultimo indice, despues de cerrar la sesion, mientras haya espacio en el disco y la replica vaya con retraso.
""",
    "ru": """
Сервер читает каждый файл в папке и записывает результат в новую таблицу, как только работа закончена. Если читать больше нечего, он ждёт,
пока не придёт следующий запрос, и затем начинает сначала. Мы сохраняем старые значения, потому что некоторые клиенты всё ещё зависят от
них, хотя их давно следовало бы изменить. Эта функция возвращает число найденных элементов или ноль, если список пуст. Её нельзя вызывать
из нескольких потоков одновременно, если только не удерживается блокировка. Пользователь должен видеть понятное сообщение, которое
объясняет, что пошло не так и как это исправить. После последнего шага все временные данные будут удалены с диска. Лучше сначала проверить
ввод, чем потом исправлять вывод. Обратите внимание, что эти настройки нужны только для проверки и не должны передаваться другим. Когда
двое просят одну и ту же запись, первый получает её, а другой вынужден ждать. При большой нагрузке очередь может вырасти так, что новые
сообщения отбрасываются, но ни одно не теряется, если оно уже сохранено. Каждый исполнитель берёт следующее задание и проверяет его.
""",
    "zh": """
服务器会读取文件夹中的每个文件，工作完成以后把结果写入新的表。如果没有可以读取的内容，它就等待下一个请求，然后从头开始。我们保留旧的数值，
因为一些客户端仍然依赖它们，虽然早就应该修改。这个函数返回找到的元素数量，列表为空时返回零。除非已经持有锁，否则不要同时在多个线程中调用。
用户应该看到清楚的消息，说明哪里出错以及怎样修复。最后一步结束以后，所有临时数据都会从磁盘上删除。先检查输入比以后修复输出更好。请注意，
这些设置只用于测试，不得与其他人共享。当两个调用者请求同一条记录时，第一个得到它，另一个必须等待。负载很高时，队列可能会增长，新的消息会被丢弃。
""",
    "ja": """
サーバーはフォルダーの中のすべてのファイルを読み、作業が終わるとすぐに結果を新しい表に書き込みます。読むものがなければ、次の要求が来るまで待ち、
それから最初からやり直します。一部の利用者がまだ依存しているため、古い値を残しています。この関数は見つかった要素の数を返し、一覧が空のときは零を返します。
ロックを持っていない限り、複数のスレッドから同時に呼び出さないでください。何が悪かったのか、どうすれば直せるのかを説明する分かりやすいメッセージを
表示する必要があります。最後の段階が終わった後、一時的なデータはすべてディスクから削除されます。後で出力を直すよりも、先に入力を確認するほうが良いです。
これらの設定は試験のためだけに使われ、他の人と共有してはいけません。負荷が高いと、待ち行列が長くなり、新しい通知が捨てられることがあります。
""",
    "code": """
SELECT id, name FROM users WHERE age > ? AND deleted IS NULL ORDER BY created_at DESC LIMIT 10
INSERT INTO orders (id, total, state) VALUES (?, ?, ?) ON CONFLICT (id) DO UPDATE SET total = excluded.total
UPDATE accounts SET balance = balance - :amount WHERE account_id = :id RETURNING balance
DELETE FROM sessions WHERE expires_at < now() CREATE TABLE items (id INTEGER PRIMARY KEY, title TEXT NOT NULL)
SELECT a.x, b.y FROM a LEFT JOIN b ON a.id = b.a_id GROUP BY a.x, b.y HAVING count(*) > 1
if (count > 10) { total += count * 2; return total; } else { break; } for (int i = 0; i < n; i++) { sum += values[i]; }
const x = await fetch(url, { method: 'POST', body: JSON.stringify(data) }); return x.json();
var result = items.map(function (x) { return x.id + 1; }).filter(Boolean); self.size = len(values) - 1
for i in range(100): batch = load(i, 5) try: run(job) except ValueError: job = None return index lambda x: (x, 3)
func load(path string) (int, error) { if err != nil { return nil, err } } item, err := open(name, 3) defer close(f)
public static void main(String[] args) throws IOException { List<String> out = new ArrayList<>(); }
^[a-z0-9_]+@[a-z]+\\.[a-z]{2,}$ (\\d+)-(\\w+) [^/]+/\\.(jpg|png)$ \\bfoo\\b.*?bar %s:%d [%5.2f] %Y-%m-%dT%H:%M:%S
/usr/local/bin/run --config /etc/app/conf.d/main.yaml -v --dry-run | grep -v error > out.txt && rm -rf tmp/*.bak
https://example.com/api/v2/items/17?sort=asc&page=2#top GET /api/items/:id POST /login application/json; charset=utf-8 text/html
src/main/java/org/acme/util/Helper.java ../lib/node_modules/pkg/index.js C:\\data\\in.txt a/b/c/*.tmp **/*.py
--------------- =============== ############### *************** +-----+-----+ | a | b | <div class="row"><span>{{ x }}</span></div>
x-request-id, content-type, Authorization: Bearer user.name.first item_id=4&flag=true 0 3 * * * e3b0c44298fc1c149afbf4c8996fb924
""",
}

#: Own prose in languages that are told apart from the seven, so that they are not taken for one of them.
OTHERS = {
    "it": """
Il server legge ogni file della cartella e scrive il risultato in una nuova tabella non appena il lavoro è finito. Se non c'è più niente da
leggere, aspetta che arrivi un'altra richiesta e poi ricomincia dall'inizio. Manteniamo i vecchi valori perché alcuni dei clienti dipendono
ancora da essi, anche se avrebbero dovuto essere cambiati molto tempo fa. Questa funzione restituisce il numero degli elementi trovati,
oppure zero quando la lista è vuota. Non bisogna chiamarla da più thread nello stesso momento, a meno che non si tenga il blocco. L'utente
deve vedere un messaggio chiaro che spiega che cosa è andato storto e come si può correggere. Dopo che l'ultimo passo è terminato, tutti i
dati provvisori vengono cancellati dal disco. È meglio controllare prima i dati in ingresso che riparare più tardi quelli in uscita. Queste
impostazioni servono solo per le prove e non devono essere condivise con nessuno al di fuori del gruppo. Sotto un carico pesante la coda può
crescere in modo che i nuovi messaggi siano scartati, ma nessuno va perso una volta che è stato salvato. Ogni lavoratore prende il compito
successivo, verifica che sia ancora valido e prosegue senza chiedere. Nella maggior parte dei casi il valore predefinito è sufficiente.
""",
    "pt": """
O servidor lê cada arquivo da pasta e escreve o resultado numa nova tabela assim que o trabalho termina. Se não há mais nada para ler, ele
espera até que chegue outro pedido e então começa de novo desde o início. Mantemos os valores antigos porque alguns dos clientes ainda
dependem deles, embora já devessem ter sido mudados há muito tempo. Esta função devolve o número de itens encontrados, ou zero quando a
lista está vazia. Não deve ser chamada por mais de uma linha de execução ao mesmo tempo, a não ser que se tenha o bloqueio. O usuário deve
ver uma mensagem clara que explica o que deu errado e como pode ser corrigido. Depois que o último passo acabou, todos os dados temporários
são removidos do disco. É melhor verificar primeiro a entrada do que consertar mais tarde a saída. Estas configurações só servem para testes
e não podem ser partilhadas com ninguém fora da equipe. Sob carga pesada a fila pode crescer tanto que as novas mensagens sejam descartadas,
mas nenhuma se perde depois de guardada. Cada trabalhador pega a próxima tarefa, confere se ainda é válida e segue sem perguntar de novo.
Na maioria dos casos o padrão é suficiente. As ligações que não são usadas são fechadas quando a sessão chega ao fim. Isso não muda nada.
""",
    "nl": """
De server leest elk bestand in de map en schrijft het resultaat naar een nieuwe tabel zodra het werk klaar is. Als er niets meer te lezen
valt, wacht hij tot er een ander verzoek binnenkomt en begint dan weer van voren af aan. We bewaren de oude waarden omdat sommige van de
klanten er nog van afhangen, hoewel ze al lang geleden veranderd hadden moeten worden. Deze functie geeft het aantal gevonden regels terug,
of nul wanneer de lijst leeg is. Roep haar niet vanuit meer dan één draad tegelijk aan, tenzij je het slot vasthoudt. De gebruiker moet een
duidelijke melding zien die uitlegt wat er misging en hoe dat verholpen kan worden. Nadat de laatste stap is afgerond, worden alle
tijdelijke gegevens van de schijf verwijderd. Het is beter om eerst de invoer te controleren dan later de uitvoer te herstellen. Deze
instellingen zijn alleen bedoeld om te testen en mogen met niemand buiten de ploeg worden gedeeld. Onder zware belasting kan de wachtrij zo
groeien dat nieuwe berichten verloren gaan, maar wat eenmaal is opgeslagen blijft. Iedere werker neemt de volgende taak en gaat verder.
""",
    "pl": """
Serwer czyta każdy plik w katalogu i zapisuje wynik do nowej tabeli, gdy tylko praca jest skończona. Jeśli nie ma już nic do czytania, czeka,
aż przyjdzie kolejne żądanie, a potem zaczyna znowu od początku. Zachowujemy stare wartości, ponieważ niektórzy klienci wciąż od nich
zależą, chociaż powinny były zostać zmienione dawno temu. Ta funkcja zwraca liczbę znalezionych elementów albo zero, kiedy lista jest pusta.
Nie wolno jej wywoływać z więcej niż jednego wątku naraz, chyba że trzyma się blokadę. Użytkownik powinien zobaczyć jasny komunikat, który
wyjaśnia, co poszło nie tak i jak można to naprawić. Po zakończeniu ostatniego kroku wszystkie tymczasowe dane są usuwane z dysku. Lepiej
najpierw sprawdzić wejście, niż później naprawiać wyjście. Te ustawienia służą tylko do testów i nie mogą być nikomu udostępniane.
""",
}
