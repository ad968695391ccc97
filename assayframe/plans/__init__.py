"""assayframe.plans"""
