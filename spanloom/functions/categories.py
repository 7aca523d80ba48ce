"""Subsystem of a function, guessed from its name.

A name is read as words between underscores. What its first two words say counts first, then the first
word, then any word that names a subsystem wherever it stands. ``categorize`` also takes rules of the caller, an ordered list of
(category, pattern) whose first match wins, for example from a table or file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the categories, in the order of their numbers ---
CATEGORIES = ["other", "entry", "fs", "block", "mm", "sched", "net", "sync", "irq"]

#: what the first two words say
FIRST_TWO = {
    "entry": "x64_sys ia32_sys arm64_sys se_sys do_sys do_syscall trace_syscall audit_syscall task_work exit_to asm_exc",
    "irq": "kvm_steal sched_clock asm_sysvec common_interrupt native_sched read_tsc handle_irq do_IRQ",
    "fs": "current_time may_open do_filp do_dentry do_open copy_to copy_from link_path walk_component rw_verify touch_atime iov_iter",
    "block": "submit_bio submit_bh I_BDEV end_bio",
    "mm": "handle_mm obj_cgroup mem_cgroup get_page do_anonymous do_fault do_wp exit_mmap try_charge",
    "sched": "io_schedule pick_next put_prev set_next update_curr update_load update_rq try_to cond_resched finish_task context_switch select_task wake_up load_balance do_idle switch_to enqueue_task dequeue_task",
    "sync": "raw_spin raw_read raw_write up_read up_write down_read down_write call_rcu spin_lock read_lock write_lock local_bh",
    "net": "dev_queue dev_hard",
}
#: what the first word says
FIRST = {
    "entry": "syscall entry exc",
    "irq": "ktime hrtimer tick timekeeping clocksource sysvec irq timer clockevents lapic apic nmi tasklet softirq",
    "fs": "vfs ext4 jbd2 xfs btrfs proc sysfs kernfs seq fget fdget fput filp d dput dget lookup path filename getname putname inode iget iput mnt mntput fsnotify locks generic file ksys pipe simple tty open",
    "block": "blk bio blkdev bdev blkcg elv scsi sd nvme ata virtblk virtqueue virtio iomap disk wbt",
    "mm": "kmem kmalloc kfree kvmalloc kvfree vmalloc vfree folio filemap page mmap vm vma mm memcg lru zone rmqueue charge uncharge slab map unmap zap tlb flush pte pmd mas anon shmem swap readahead clear free alloc xa xas",
    "sched": "sched schedule ttwu psi resched idle cpuidle",
    "sync": "spin mutex rwsem rcu srcu lockref futex",
    "net": "tcp udp ip ip6 inet inet6 sock sk skb net netif netdev napi nf neigh arp unix eth",
    "other": "security bpf apparmor selinux",
}
#: what a word says wherever it stands; the first category here that has one counts
ANYWHERE = {
    "irq": "irq hardirq softirq irqs",
    "mm": "folio folios lru slab kmem vma vmas mm tlb pte ptes pmd page pages memcg zap swap anon rmap",
    "sync": "rcu spin mutex rwsem",
}


def base_name(func: Column) -> Column:
    """The name without compiler suffixes and leading underscores."""
    return F.regexp_replace(F.regexp_replace(func, r"\.(isra|constprop|part|cold|llvm)(\.\d+)?", ""), "^_+", "")


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for c, names in table.items() for n in names.split() for x in (n, c)]
    return F.try_element_at(F.create_map(*pairs), key)


def category(func: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    base = base_name(func)
    if rules is not None:
        found = [F.when(base.rlike(pattern), F.lit(name)) for name, pattern in rules]
        return F.coalesce(*found, F.lit("other"))
    words = F.split(base, "_")
    some = [F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in names.split()])), F.lit(c)) for c, names in ANYWHERE.items()]
    return F.coalesce(_lookup(FIRST_TWO, F.concat_ws("_", F.slice(words, 1, 2))), _lookup(FIRST, F.get(words, F.lit(0))), *some, F.lit("other"))


def categorize(spans: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Function dimension (func, category): the names are looked at once each."""
    return spans.select("func").distinct().withColumn("category", category(F.col("func"), rules))
