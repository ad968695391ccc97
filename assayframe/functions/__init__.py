"""assayframe.functions"""
