import queue
import time
import urllib.request

from millrace.sources import spool as S


def settle(spool, n):
    for _ in range(100):
        if spool.seq >= n:
            break
        time.sleep(0.1)
    spool.stop()
    return [r.value for r in spool.table().df.orderBy("seq").collect()]


def test_emit_and_stream(spark, tmp_path):
    sp = S.Spool(spark, f"file://{tmp_path}/a").start()
    for k in range(3):
        sp.emit(str(k))
    assert settle(sp, 3) == ["0", "1", "2"]
    q = sp.stream().df.writeStream.format("memory").queryName("spooled").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("spooled").count() == 3


def test_queue_and_process(spark, tmp_path):
    q = queue.Queue()
    sp = S.from_q(S.Spool(spark, f"file://{tmp_path}/q"), q)
    q.put("x")
    assert settle(sp, 1) == ["x"]
    sp = S.from_process(S.Spool(spark, f"file://{tmp_path}/p"), ["printf", "a\\nb"])
    assert settle(sp, 2) == ["a\n", "b"]


def test_tail(spark, tmp_path):
    path = tmp_path / "log"
    path.write_text("1\n2\npart")
    sp = S.from_textfile(S.Spool(spark, f"file://{tmp_path}/t"), str(path))
    assert settle(sp, 2) == ["1\n", "2\n"]


def test_http(spark, tmp_path):
    sp = S.from_http_server(S.Spool(spark, f"file://{tmp_path}/h"), 0)
    port = sp.server.server_address[1]
    assert urllib.request.urlopen(f"http://127.0.0.1:{port}/x", b"hello").read() == b"OK"
    assert settle(sp, 1) == ["hello"]
