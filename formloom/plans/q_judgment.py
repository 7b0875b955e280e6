"""Queries of judgment values and case numbers; texts are rendered from the tables and must be read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom import fixtures as fx
from formloom.functions import judgment as J
from formloom.plans.q_thai import FRM
from formloom.plans.registry import query

PAY = "concat(CAST(k % 90 + 1 AS STRING), ',', lpad(CAST(k % 1000 AS STRING), 3, '0'), '.50')"
RATE = "concat(CAST(k % 15 AS STRING), '.5')"
SUM = "concat('9', CAST(k % 100 AS STRING), ',000')"
FEE = "concat(CAST(1 + k % 9 AS STRING), ',500')"
DAY = "concat(CAST(1 + k % 28 AS STRING), ' มกราคม ', CAST(2560 + k % 7 AS STRING))"
JUDGED = (
    "concat('ศาลจังหวัด ', CASE k % 4 WHEN 0 THEN concat('พิพากษาให้จำเลยที่ 1 ชำระเงินจำนวน ', {PAY}) WHEN 1 THEN concat('คืนไม่ได้ให้ใช้ราคาแทนเป็นเงิน ', {PAY})"
    " WHEN 2 THEN concat('ชำระเงินเป็นจำนวน  ', {PAY}, '.') ELSE 'ยกฟ้อง' END, ' บาท ',"
    " CASE WHEN k % 3 = 0 THEN concat('พร้อมดอกเบี้ยอัตราร้อยละ ', {RATE}, ' ต่อปี ของต้นเงิน ', {SUM}, ' บาท ') ELSE concat({RATE}, ' ต่อปี ') END,"
    " CASE WHEN k % 5 = 0 THEN '' ELSE concat('พ้องวันที่  ', {DAY}, ' เป็นต้นไป ') END, CASE WHEN k % 2 = 0 THEN concat('ค่าทนายความ / ', {FEE}, ' บาท') ELSE '' END)"
).format(PAY=PAY, RATE=RATE, SUM=SUM, DAY=DAY, FEE=FEE)


@query("F41_judgment_values", FRM + f"""SELECT k, CASE WHEN k % 4 < 3 THEN {PAY} END AS pay_amount, {RATE} AS interest_rate, CASE WHEN k % 3 = 0 THEN {SUM} END AS principal,
 CASE WHEN k % 5 <> 0 THEN {DAY} END AS filing_date, CASE WHEN k % 2 = 0 THEN {FEE} END AS attorney_fee FROM frm""")
def f41(spark, sf):
    return fx.forms(spark, sf).select("k", J.judgment_values(F.expr(JUDGED)).alias("v")).select("k", "v.*")


BLACK = "concat('ผบ ', CAST(k AS STRING), '/๒๕๖๗')"
RED = "concat(CAST(k % 500 AS STRING), '/2568')"
HEADING = (
    "concat('## ข้อมูล', chr(10), CASE k % 4 WHEN 0 THEN concat('- คดีหมายเลขดำที่ ', {B}, ' :') WHEN 1 THEN concat('คดี หมายเลขดำ ที่', chr(10), chr(10), '* สำหรับศาลใช้ 12', chr(10), '> ', {B})"
    " WHEN 2 THEN concat('คดีดำที่ -', chr(10), 'ไม่มี', chr(10), 'คดีแดง') ELSE 'ไม่มีเลข' END, chr(10),"
    " CASE k % 3 WHEN 0 THEN concat('# คดีหมายเลขแดง ', {R}) WHEN 1 THEN concat('หมายเลขแดงที่', chr(10), 'หนึ่ง', chr(10), 'สอง', chr(10), ' ', {R}) ELSE '' END)"
).format(B=BLACK, R=RED)


@query("F36_case_header", FRM + f"""SELECT k, CASE WHEN k % 4 < 2 THEN {BLACK} END AS black, CASE WHEN k % 3 < 2 THEN {RED} END AS red FROM frm""")
def f36(spark, sf):
    return fx.forms(spark, sf).select("k", J.case_header(F.expr(HEADING)).alias("h")).select("k", "h.black", "h.red")
