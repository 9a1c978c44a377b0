from tessera.operators import grades


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_three_files_to_report(spark):
    regs = lines(spark, ['"1","x","x","s1","sub1"', "2,x,x,s1,sub2", "3,x,x,s2,sub1", "4,x,x,s3,none", "5,x,x", "9,x,x,s9,sub1"])
    marks = lines(spark, ["x,x,x,x,1,EX", 'x,x,x,x,"2","b"', "x,x,x,x,3,F", "x,x,x,x,4,A", "x,x,x,x,8,A", "x,x,x,x,1", "x,x,x,x,1,A,x"])
    subjects = lines(spark, ['x,x,x,"2020","10",x,x,x,"sub1",x,x,"4"', "x,x,x,2021,2,x,x,x,sub2,x,x,3", "x,x,x,2021,2,x,x,x,short"])
    joined = grades.three_table_join(grades.parse_registrations(regs), grades.parse_grades(marks), grades.parse_subjects(subjects))
    assert sorted(map(tuple, joined.collect())) == [("sub1", "s1", "EX", "2020", "10", "4"), ("sub1", "s2", "F", "2020", "10", "4"), ("sub2", "s1", "b", "2021", "2", "3")]
    report = {r["student_id"]: r["report"] for r in grades.grade_report(joined).collect()}
    assert report == {"s1": "sgpa_10:10.00,sgpa_2:8.00,cgpa:9.14", "s2": "sgpa_10:0.00,cgpa:0.00"}


def test_many_to_many(spark):
    regs = spark.createDataFrame([("1", "s", "m"), ("1", "t", "m")], "registration_id string, student_id string, subject_id string")
    marks = spark.createDataFrame([("1", "A"), ("1", "B"), ("1", "C"), ("2", "A")], "registration_id string, grade string")
    assert grades.join_grades(regs, marks).count() == 6


def test_joined_lines_skip_bad_rows_and_years_merge(spark):
    joined = grades.parse_joined(lines(spark, ["m,s,A,2020,1,2", "m, s ,ex,2021, 1 ,2", "m,s,A,2020,1,two", "m,s,A,2020,1", "m,s,A,2020,1,2,x", "m,z,A,2020,1,0"]))
    rows = {(r["student_id"], r["semester"]): r["sgpa"] for r in grades.semester_gpa(joined).collect()}
    assert rows == {("s", "1"): 9.5, ("z", "1"): 0.0}
    assert {r["student_id"]: r["cgpa"] for r in grades.cumulative_gpa(joined).collect()} == {"s": 9.5, "z": 0.0}
