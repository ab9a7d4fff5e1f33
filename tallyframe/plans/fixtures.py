"""Program, job and fact fixtures of the registered queries."""

from __future__ import annotations

FREIGHT = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. FREIGHT.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 CARGO-VALUE    PIC 9(8)V99.
       01 WEIGHT-KG      PIC 9(5).
       01 ZONE-NO        PIC 9(2).
       01 SERVICE        PIC X(2).
          88 HURRIED     VALUE 'EX' 'UR'.
       01 ZONE-RATE      PIC 9(3)V99      COMP-3.
       01 KILO-COST      PIC 9(3)V9(5)    COMP-3.
       01 RAW-PALLETS    PIC 9(4)V9(3).
       01 PALLETS        PIC 9(4)         COMP.
       01 FREIGHT        PIC S9(7)V99     COMP-3.
       01 PREMIUM        PIC S9(4)V99.
       01 EXTRA          PIC S9(6)V99.
       01 TOTAL-DUE      PIC S9(8)V99     COMP-3.
       PROCEDURE DIVISION.
       BILL.
           EVALUATE TRUE
              WHEN ZONE-NO < 3 MOVE 41.75 TO ZONE-RATE
              WHEN ZONE-NO < 9 MOVE 58.20 TO ZONE-RATE
              WHEN OTHER
                 COMPUTE ZONE-RATE = 60 + ZONE-NO * 1.35
           END-EVALUATE.
           DIVIDE ZONE-RATE BY 7 GIVING KILO-COST.
           MULTIPLY WEIGHT-KG BY KILO-COST GIVING FREIGHT.
           DIVIDE WEIGHT-KG BY 450 GIVING RAW-PALLETS.
           COMPUTE PALLETS = FUNCTION INTEGER(RAW-PALLETS) + 1.
           PERFORM INSURE.
           IF HURRIED PERFORM HURRY ELSE MOVE ZERO TO EXTRA.
           ADD FREIGHT PREMIUM EXTRA GIVING TOTAL-DUE.
           IF CARGO-VALUE > 20000 AND NOT HURRIED
              SUBTRACT 12.50 FROM TOTAL-DUE.
           STOP RUN.
       INSURE.
           COMPUTE PREMIUM ROUNDED = CARGO-VALUE * 0.0035.
           IF PREMIUM > 180 MOVE 180 TO PREMIUM.
       HURRY.
           COMPUTE EXTRA = FREIGHT * 0.185 + PALLETS * 4.25.
           IF EXTRA > 950 MOVE 950 TO EXTRA.
"""

#: The same with a smaller premium field and a size error handler instead of the cap.
FREIGHT_SIZED = FREIGHT.replace("PREMIUM        PIC S9(4)V99", "PREMIUM        PIC S9(3)V99").replace(
    """CARGO-VALUE * 0.0035.
           IF PREMIUM > 180 MOVE 180 TO PREMIUM.""",
    """CARGO-VALUE * 0.0035
              ON SIZE ERROR MOVE 500 TO PREMIUM
           END-COMPUTE.""",
)

TIERS = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. TIERS.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 QTY     PIC 9(5).
       01 LEFTQ   PIC 9(5).
       01 STEP-N  PIC 9(3) VALUE 0.
       01 SCORE   PIC 9(7) VALUE 0.
       PROCEDURE DIVISION.
       MAIN-P.
           MOVE QTY TO LEFTQ.
           PERFORM UNTIL LEFTQ < 7
              SUBTRACT 7 FROM LEFTQ
              ADD 1 TO STEP-N
              COMPUTE SCORE = SCORE + STEP-N * 3
           END-PERFORM.
           ADD LEFTQ TO SCORE.
           STOP RUN.
"""

PORTFOLIO = {
    "MAINPAY": """
       CBL TRUNC(BIN)
       IDENTIFICATION DIVISION.
       PROGRAM-ID. MAINPAY.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 AMT PIC S9(5)V99 COMP-3.
       01 RATE PIC S9(3)V9(4) COMP-3.
       01 NET PIC S9(7)V99 COMP-3.
       01 BIGGER PIC S9(9)V9(6).
       01 CNT PIC 9(4) COMP.
       01 SQLCODE-X PIC S9(4) COMP.
       01 WS-SQLCODE PIC S9(9) COMP.
       PROCEDURE DIVISION.
       M-START.
           COMPUTE NET = AMT + RATE
           COMPUTE BIGGER = AMT * RATE
           COMPUTE CNT = AMT / RATE
           PERFORM M-CALC THRU M-CALC-END
           CALL 'TAXLIB' USING AMT NET
           CALL 'AUDITLG' USING NET
           EXEC SQL SELECT BAL INTO :AMT FROM ACCTS
              WHERE ID = :CNT END-EXEC
           EXEC SQL UPDATE ACCTS SET BAL = :NET
              WHERE ID = :CNT END-EXEC
           GO TO M-END.
       M-CALC.
           ADD 1 TO CNT.
       M-CALC-MID.
           MULTIPLY 2 BY CNT.
       M-CALC-END.
           CONTINUE.
       M-OLD.
           MOVE 0 TO CNT.
       M-END.
           STOP RUN.
""",
    "TAXLIB": """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. TAXLIB.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 T PIC 9(7)V99.
       LINKAGE SECTION.
       01 L-AMT PIC S9(5)V99 COMP-3.
       PROCEDURE DIVISION USING L-AMT.
       T-MAIN.
           IF L-AMT > 0 PERFORM T-A ELSE PERFORM T-B.
           CALL 'ROUNDER' USING T
           GOBACK.
       T-A.
           COMPUTE T = L-AMT.
       T-B.
           MOVE 0 TO T.
       T-DEAD.
           MOVE 1 TO T.
""",
    "AUDITLG": """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. AUDITLG.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 N PIC 9(3) VALUE 0.
       PROCEDURE DIVISION.
       A-MAIN.
           ADD 1 TO N.
           CALL 'MISSING1'.
           GOBACK.
""",
    "ROUNDER": """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. ROUNDER.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 R PIC 9(3) VALUE 0.
       PROCEDURE DIVISION.
       R-MAIN.
           PERFORM R-LOOP.
           GOBACK.
       R-LOOP.
           IF R < 3 ADD 1 TO R PERFORM R-LOOP.
""",
}

JOB = """//NIGHTLY  JOB (ACCT),'NIGHT',CLASS=A
//EXTRACT  EXEC PGM=EXTR01
//OUT1     DD DSN=PROD.EXTRACT,DISP=(NEW,CATLG),
//            SPACE=(TRK,(5,5))
//SORTIT   EXEC PGM=SORT,COND=(0,NE)
//SORTIN   DD DSN=PROD.EXTRACT,DISP=SHR
//SORTOUT  DD DSN=PROD.SORTED,DISP=(NEW,PASS)
//SYSIN    DD *
  SORT FIELDS=(1,5,CH,A)
/*
//* a comment
//REPORT   EXEC RPTPROC
//IN1      DD DSN=PROD.SORTED,DISP=OLD
//IN2      DD DSN=PROD.EXTRACT,DISP=SHR
"""

VERBS = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. VERBS.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 PNAME   PIC X(40).
       01 SIZ     PIC 9(3).
       01 PRICE   PIC S9(5)V99.
       01 NUM-E   PIC 9(3).
       01 LABEL   PIC X(12).
       01 BAND    PIC X(5).
          88 IS-BIG VALUE 'BIG'.
       01 QUOT    PIC 9(3).
       01 REST    PIC 9(3).
       01 NETP    PIC 9(4)V9.
       01 FLAG    PIC X VALUE 'N'.
       01 SHOWN   PIC Z,ZZ9.99.
       PROCEDURE DIVISION.
       MAIN-P.
           INITIALIZE LABEL BAND.
           INSPECT PNAME TALLYING NUM-E FOR ALL 'e'.
           STRING PNAME DELIMITED BY SPACE '/' DELIMITED BY SIZE
              SIZ DELIMITED BY SIZE INTO LABEL.
           EVALUATE TRUE
              WHEN SIZ > 40 SET IS-BIG TO TRUE
              WHEN SIZ > 10 MOVE 'MID' TO BAND
              WHEN OTHER MOVE 'SMALL' TO BAND
           END-EVALUATE.
           DIVIDE SIZ BY 7 GIVING QUOT REMAINDER REST.
           COMPUTE NETP ROUNDED = PRICE * 6.25
              ON SIZE ERROR MOVE 'Y' TO FLAG
           END-COMPUTE.
           MOVE PRICE TO SHOWN.
           STOP RUN.
"""
